"""What one task holds does not grow with the tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import SMALL, as_rows
from tidemark.operators import reports, trends
from tidemark.sources import bars as B
from tidemark.sources.versions import Versions


def test_reports_known_at_a_date_are_dealt_by_the_size_of_the_table(spark, duck, monkeypatch):
    """Six thousand lines of which a task has a thousand: seven partitions, whatever the session's number (4)."""
    monkeypatch.setattr(B, "ROWS_A_PIECE", 1000)
    pieces = B.read(spark, SMALL, "lineitem").count() // 1000 + 1
    got = __spark_entry__.queries()["asof_point_in_time"](spark, SMALL)
    assert pieces > 4 and got.rdd.getNumPartitions() == pieces
    assert as_rows(got.toPandas()) == as_rows(duck.execute(__spark_entry__.oracle_sql()["asof_point_in_time"]).df())


@pytest.mark.parametrize("stored_first", [False, True])
def test_rows_that_are_merged_are_made_once(spark, tmp_path, stored_first):
    t = Versions(spark, f"file://{tmp_path}/t", "code string, n long, day string", ("day",))
    t.replace(spark.createDataFrame([("a", 1, "d1"), ("b", 2, "d1"), ("a", 3, "d2")], "code string, n long, day string"))
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda day: made.add(1) or day, "string").asNondeterministic()
    t.merge(spark.createDataFrame([("a", 10, "d1"), ("c", 30, "d1"), ("c", 40, "d3")], "code string, n long, day string").withColumn("day", seen("day")), "code", stored_first=stored_first)
    assert made.value == 3
    assert {tuple(r) for r in t.read().collect()} == {("a", 1 if stored_first else 10, "d1"), ("b", 2, "d1"), ("c", 30, "d1"), ("a", 3, "d2"), ("c", 40, "d3")}
    # A partition whose files lie in two writes is replaced, and dropped, as one.
    t.replace(spark.createDataFrame([("z", 9, "d1")], "code string, n long, day string"))
    assert {tuple(r) for r in t.read().collect()} == {("z", 9, "d1"), ("a", 3, "d2"), ("c", 40, "d3")}
    t.vacuum()
    assert t.read().count() == 3


DAYS = 47


@pytest.fixture(scope="module")
def series(spark):
    """Two series of uneven closes, and one with gaps."""
    rows = [(code, d, 10.0 + (d * k) % 7, 11.0 + (d * k) % 9, 9.0 + (d * k) % 5, None if k == 5 and d % 6 == 0 else 10.0 + (d * d * k) % 11, float(100 + (d * k) % 13)) for code, k in (("a", 3), ("b", 4), ("c", 5)) for d in range(DAYS)]
    return spark.createDataFrame(rows, "code string, date int, open double, high double, low double, close double, volume double")


def sorts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Sort [")


def test_trades_get_their_states_in_one_pass(spark, series):
    """As the join of returns with states, but of one shuffle and one sort."""
    from pyspark.sql import Window

    s = Window.partitionBy("code").orderBy("date")
    bars = series.where("close is not null")
    smooth = bars.select("code", "date", F.avg("close").over(s.rowsBetween(-3, 0)).alias("close"))
    returns = bars.where("close > 0").select("code", "date", ((F.lead("close", 5).over(s) / F.col("close") - 1) * 100).alias("ret_pct"))
    want = returns.join(reports.market_states(smooth, "code"), ["code", "date"])
    got = reports.returns_in_states(series, 5, smooth=4)
    key = lambda r: (r.code, r.date)
    assert sorted(got.select("code", "date", "state", "ret_pct").collect(), key=key) == sorted(want.select("code", "date", "state", "ret_pct").collect(), key=key)
    assert sorts(got) == 1
    own = {r.state: r.asDict() for r in reports.trades_by_state(got).collect()}
    assert own == {r.state: r.asDict() for r in reports.trades_by_state(returns, reports.market_states(smooth, "code"), "code", "date").collect()} and len(own) > 1


def test_states_of_series_by_two_keys(spark, series):
    two = series.select(F.col("code").alias("k"), (F.col("date") % 2).alias("j"), F.col("date").alias("t"), "close")
    got = {(r.k, r.j, r.t): r.state for r in reports.market_states(two, "k", "j", order="t").collect()}
    one = series.select(F.concat("code", (F.col("date") % 2).cast("string")).alias("code"), "date", "close")
    assert got == {(r.code[0], int(r.code[1]), r.date): r.state for r in reports.market_states(one, "code").collect()} and len(got) == series.where("close is not null").count()


def test_states_of_one_series_without_keys(series):
    one = series.where("code = 'b'")
    assert sorted(reports.market_states(one.drop("code")).collect()) == sorted(reports.market_states(one, "code").drop("code").collect())


def test_weeks_are_scored_in_one_pass(series):
    got = trends.weekly_scores(series)
    assert sorts(got) == 1
    rows = {(r.code, r.date): r for r in got.collect()}
    close = {(r.code, r.date): r.close for r in series.collect()}
    volume = {(r.code, r.date): r.volume for r in series.collect()}
    assert len(rows) == 3 * DAYS
    for (code, d), r in rows.items():
        last = (d // 5 - 4) * 5 + 4  # the last row of the fourth week before
        want = (close[code, d] / close[code, last] - 1) * 100 if d >= 20 and close[code, d] is not None and close[code, last] else None
        assert (r.momentum_4w is None and want is None) or abs(r.momentum_4w - want) < 1e-9
        first = d // 5 * 5
        if d >= 35:
            now, before = (sum(volume[code, n] for n in span) for span in (range(first - 15, d + 1), range(first - 35, first - 15)))
            assert abs(r.volume_trend - (now / before - 1) * 100) < 1e-9
        else:
            assert r.volume_trend is None


def test_reversals_are_scored_in_one_pass(series):
    got = trends.reversal_scores(series, 9.5)
    assert sorts(got) == 1 and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.code, r.date): r for r in got.collect()}
    close = {(r.code, r.date): r.close for r in series.collect()}
    assert len(rows) == 3 * DAYS
    for (code, d), r in rows.items():
        up = [bool(n and close[code, n - 1] and close[code, n] and (close[code, n] / close[code, n - 1] - 1) * 100 >= 9.5) for n in range(max(d - 19, 0), d + 1)]
        run = max(len(part) for part in "".join("1" if u else "0" for u in up).split("0"))
        assert (r.limit_ups, r.limit_run) == (sum(up), run) and (r.score is None) == (d < 4)
