"""Queries against their DuckDB twins where some prices are 0, and rules that only larger tables show."""

from __future__ import annotations

import os
import random
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL, as_rows

import __spark_entry__  # noqa: F401
from tidemark.functions.panel import rounded_to
from tidemark.operators import algebra, clock_pack, packs, reports, signals, technical, trends
from tidemark.plans import registry

QUERIES = [
    "factor_price_scores", "metric_against_holding", "metric_by_score", "metric_trades", "report_against_index", "report_contributions", "report_pooled", "report_score_spread", "report_sector_effects", "session_trailing",
]


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """The smallest tables, with fewer users, so that days follow each other, and a value of 0 in every fifth event."""
    folder = tmp_path_factory.mktemp("zeros")
    for name in os.listdir(SMALL):
        if name != "events.parquet":
            os.symlink(f"{SMALL}/{name}", folder / name)
    duckdb.execute(f"copy (select * replace (user_id % 5 as user_id, case when event_id % 5 = 0 then 0.0 else value end as value) from '{SMALL}/events.parquet') to '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_zero_prices(spark, zeros, name):
    con = duckdb.connect()
    for table in ("events", "customer"):
        con.execute(f"create view {table} as select * from '{zeros}/{table}.parquet'")
    got = registry.QUERIES[name](spark, zeros).toPandas()
    want = con.execute(registry.ORACLES[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    assert as_rows(got) == as_rows(want)


def test_wide_prefix_of_zero_prices(spark, tmp_path):
    """A low or an open of 0 is a price; what is divided by it is infinite, not left out."""
    con = duckdb.connect()
    con.execute(f"""copy (select i as event_id, timestamp '2024-01-01 09:30:00' + to_minutes(cast(i // 240 * 1440 + i % 240 * 3 // 2 as bigint)) + to_microseconds(i) as ts, i % 3 as user_id, 'view' as event_type,
        case when hash(i // 240, 7) % 2 = 0 and i % 240 = 0 or i % 50 = 30 then 0.0 else hash(i) % 900 / 100 + 1 end as value, '' as props from range(1440) r(i)) to '{tmp_path}/events.parquet'""")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = registry.QUERIES["session_wide_prefix"](spark, str(tmp_path)).toPandas()
    want = con.execute(registry.ORACLES["session_wide_prefix"]).df()
    assert (want.bounce_from_low == float("inf")).any() and (want.ret_open_to_tau == float("inf")).any() and (want.ret_open_to_tau < 1e9).any()
    assert as_rows(got) == as_rows(want)


def test_rounded_to(spark):
    values = [182.34425, -182.34425, 2.675, 0.5, -0.5, 1e300, None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", *(rounded_to(F.col("v"), d).alias(f"d{d}") for d in (0, 2, 4))).orderBy("i").collect()
    for row, v in zip(got, values):
        assert [row[f"d{d}"] for d in (0, 2, 4)] == [duckdb.execute(f"select round(?::double, {d})", [v]).fetchone()[0] for d in (0, 2, 4)]


def test_limit_of_turnover_is_held_against_the_turnover(spark):
    orders = spark.createDataFrame([(1, "buy", 1000.01), (2, "buy", 1000.0)], "code long, side string, amount double")
    equity = spark.createDataFrame([(1, 1000.0), (2, 1000.0)], "code long, equity double")
    got = {r.code: (r.turnover_pct, r.over_limit) for r in reports.traded_amounts(orders, equity, "code", limit_pct=50).collect()}
    assert got == {1: (50.0, True), 2: (50.0, False)}


def test_penalties_of_equal_error_are_all_selected(spark):
    rows = spark.createDataFrame([(1, f"2024-01-{i + 1:02}", float(i % 2) * 1e4, float(i % 2) * 3e4 + i % 3) for i in range(30)], "code long, date string, x double, y double")
    got = algebra.penalty_path(rows, ["x"], "y", grid=(0.0, 1e-6, 1e-5)).collect()
    assert got[0].mse == got[1].mse
    best = min(r.mse for r in got)
    assert [r.selected for r in got] == [r.mse == best for r in got] and sum(r.selected for r in got) >= 2


def test_open_pack_carries_series_across_batches(spark):
    """Batches that end anywhere, also within a series, change nothing; and no batch is needed whole."""
    from tidemark.operators import packs

    rows = [(code, f"2024-{1 + i // 28:02}-{1 + i % 28:02}", 10.0 + (i * 7 + (code or 0)) % 11, 22.0, 9.0 - i % 3, float(100 + (i * 13) % 17)) for code in (None, 1, 2) for i in range(90)]
    bars = spark.createDataFrame(rows, "code long, date string, open double, high double, low double, volume double").repartition(3)
    want = as_rows(packs.open_pack(bars, (5, 60)).toPandas())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        plan = packs.open_pack(bars, (5, 60))
        got = as_rows(plan.toPandas())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and sum(row[-1] != "~" for row in got) > 80
    # Sliding windows of Spark add each of their rows again for every row.
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_clock_pack_is_one_pass_in_any_batches(spark):
    """Batches may part a day's slots from its bar; slots of days without a bar say nothing."""
    rng = random.Random(8)
    rows = [(k, date(2024, 1, 1) + timedelta(i), *(rng.uniform(5, 9) for _ in range(4)), float(rng.randint(0, 9))) for k in ("a", "b", None) for i in range(66)]
    bars = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double")
    slots = [(k, date(2024, 1, 1) + timedelta(i), 570 + 5 * m, *(rng.uniform(5, 9) for _ in range(3)), 1.0) for k in ("a", "b", "c", None) for i in range(0, 70, 2) for m in range(1, 5)]
    slots = spark.createDataFrame(slots, "code string, date date, minute int, high double, low double, close double, volume double")
    plan = clock_pack.clock_pack(bars, slots, [0, 580], (5, 60), digits=6)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Window" not in text and "Join" not in text
    want = as_rows(plan.toPandas())
    assert len(want) == 2 * 3 * 66 and sum(row[2] != "~" for row in want) > 0
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        assert as_rows(clock_pack.clock_pack(bars, slots, [0, 580], (5, 60), digits=6).toPandas()) == want
    finally:
        spark.conf.set(size, usual)
    by_key = {(r.code, r.date, r.tau): r for r in plan.collect()}
    last = date(2024, 1, 1) + timedelta(65)
    assert by_key["a", last, 580].RANGE_PCT == 0 and by_key["a", last - timedelta(1), 580].RANGE_PCT > 0 and by_key[None, last - timedelta(1), 580].RANGE_PCT == 0


def test_gap_pack_is_one_pass_in_any_batches(spark):
    """Batches that end anywhere change nothing; the first row has no gap, and missing prices do not count in a mean."""
    rng = random.Random(9)
    rows = [(k, date(2024, 1, 1) + timedelta(i), *(None if i == 30 else rng.uniform(5, 9) for _ in range(4)), float(rng.randint(0, 9))) for k in ("a", "b", None) for i in range(45)]
    bars = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double")
    plan = packs.gap_pack(bars, digits=6)
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    want = as_rows(plan.toPandas())
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        assert as_rows(packs.gap_pack(bars, digits=6).toPandas()) == want
    finally:
        spark.conf.set(size, usual)
    got = {(r.code, r.date): r for r in plan.collect()}
    day = lambda i: date(2024, 1, 1) + timedelta(i)
    assert got[None, day(0)].GAP is None and got[None, day(1)].GAP is not None and got["b", day(31)].GAP is None and got["b", day(33)].GAP_ATR is not None


@pytest.mark.parametrize("name", ["pack_open_10", "pack_open_20", "pack_gap", "pack_clock"])
def test_packs_are_rounded_in_their_tasks(spark, name):
    """A projection that rounds tens of columns is too large to be compiled by the JVM."""
    assert "rint" not in registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("query", ["combined", "pattern_scores", "macd", "rsi", "kdj", "directional_index"])
def test_recursive_series_are_one_pass_in_any_batches(spark, query):
    """Batches that end anywhere change nothing; no series is copied at each of its rows, and nothing is joined back by code and date."""
    rng = random.Random(10)
    rows = [(k, date(2024, 1, 1) + timedelta(i), *(None if i == 30 else rng.uniform(5, 9) for _ in range(4)), float(rng.randint(0, 9))) for k, n in (("a", 50), ("b", 45), ("c", 7), (None, 50)) for i in range(n)]
    bars = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double")
    of = next(getattr(m, query) for m in (signals, trends, technical) if hasattr(m, query))
    text = of(bars)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "aggregate(" not in text and "Join" not in text
    want = as_rows(of(bars).toPandas())
    assert len(want) > 50
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        assert as_rows(of(bars).toPandas()) == want
    finally:
        spark.conf.set(size, usual)


def test_high_water_takes_events_in_any_order_and_parts(spark, tmp_path):
    """An entity's events come in parts (Arrow batches) that are in no order; times repeat."""
    con = duckdb.connect()
    con.execute(f"copy (select i as event_id, timestamp '2024-01-01' + to_seconds(cast((i * 37) % 101 as bigint)) as ts, i % 3 as user_id, 'view' as event_type, 1.0 as value, '' as props from range(400) r(i)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(registry.ORACLES["stream_high_water"]).df()
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        got = registry.QUERIES["stream_high_water"](spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.set(size, usual)
    assert as_rows(got) == as_rows(want) and want.n_late.min() > 0


def test_clock_pack_meets_its_slots_in_adaptive_plans(spark):
    """Bars and slots come dealt by entity, and far more slots than bars: partitions that are put together adaptively must be the same of both."""
    day = lambda i: date(2024, 1, 1) + timedelta(i)
    bars = spark.createDataFrame([(k, day(i), 5.0 + i % 3, 9.0, 4.0, 6.0, 10.0) for k in range(12) for i in range(63)], "code int, date date, open double, high double, low double, close double, volume double")
    slots = spark.createDataFrame([(k, day(i), 570 + m, 8.0, 5.0 - m % 2, 7.0, 1.0) for k in range(12) for i in range(60, 63) for m in range(1, 120)], "code int, date date, minute int, high double, low double, close double, volume double")
    confs = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    usual = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = clock_pack.clock_pack(bars.repartition("code"), slots.repartition("code"), [580], (5,), digits=4, dates_as_text=True).where("OPEN0 is not null").toPandas()
    finally:
        for k, v in usual.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(got.date.unique()) == ["2024-03-01", "2024-03-02", "2024-03-03"] and len(got) == 36
    assert (got.CLOSE0 < 1).all() and (got.RANGE_PCT > 0).all()


def test_clock_pack_is_not_projected_again(spark):
    """Each row of 227 columns is copied once: dates are made text in the tasks."""
    assert registry.QUERIES["pack_clock"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
