"""Rules that the tables do not reach: missing values, ties, short series, empty frames."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel
from tidemark.operators import asof, backtest, labels, merge, metrics, models, portfolio, session, technical, xsec

P = Panel()
BARS = "code long, date date, open double, high double, low double, close double, volume double"


def bars(spark, closes, code=1, start=date(2024, 1, 1)):
    rows = [(code, start + timedelta(i), c, c, c, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def column(df, name):
    return [r[name] for r in df.orderBy("code", "date").collect()]


def test_windows_must_be_full_and_finite(spark):
    df = bars(spark, [1.0, 2.0, float("nan"), 4.0, 5.0, float("inf"), 7.0])
    assert column(df.select("*", P.mean(F.col("close"), 2).alias("x")), "x") == [None, 1.5, None, None, 4.5, None, None]


def test_ts_rank_counts_ties_half(spark):
    df = bars(spark, [1.0, 2.0, 2.0])
    assert column(df.select("*", P.ts_rank(F.col("close"), 3).alias("x")), "x")[-1] == pytest.approx((1 + 2 / 2) / 3)


def test_small_divisors_give_null(spark):
    df = bars(spark, [0.0, 1.0])
    assert column(df.select("*", P.roc(F.col("close"), 1).alias("x")), "x") == [None, None]


def test_cross_sections_of_one_or_flat(spark):
    df = bars(spark, [3.0]).unionByName(bars(spark, [3.0], code=2)).unionByName(bars(spark, [5.0], code=3, start=date(2024, 2, 1)))
    got = df.select("code", "date", P.cs_zscore(F.col("close")).alias("a"), P.panel_zscore(F.col("close")).alias("b"), P.cs_rank(F.col("close")).alias("r"))
    assert column(got, "a") == [0.0, 0.0, None]
    assert column(got, "b") == [0.0, 0.0, 0.0]
    assert column(got, "r") == [0.75, 0.75, 1.0]


def test_cube_sigma_of_flat_feature_is_null(spark):
    df = bars(spark, [3.0]).unionByName(bars(spark, [3.0], code=2))
    cube = xsec.day_cube(df, ["close"]).collect()
    assert [(r["n"], r["mu"], r["sigma"]) for r in cube] == [(2, 3.0, None)]


def test_upsert_never_takes_incomplete_rows(spark):
    old = bars(spark, [1.0, None])
    new = bars(spark, [None, 9.0, 8.0])
    assert column(merge.upsert(old, new), "close") == [1.0, 9.0, 8.0]
    assert column(merge.upsert(old, new, "existing"), "close") == [1.0, 9.0, 8.0]
    with pytest.raises(ValueError):
        merge.upsert(old, new, "neither")


def test_asof_ties_and_misses(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 5, 10), (1, 5, 20), (1, 3, 5), (3, 1, 0)], "k long, s long, v long")
    at = {(r["k"], r["t"]): r["v"] for r in asof.backward(left, right, "k", "t", "s", tie="v").collect()}
    assert at == {(1, 5): 20, (1, 1): None, (2, 5): None}
    before = {(r["k"], r["t"]): r["v"] for r in asof.backward(left, right, "k", "t", "s", strict=True).collect()}
    assert before[1, 5] == 5
    after = {(r["k"], r["t"]): r["s"] for r in asof.forward(left, right, "k", "t", "s").collect()}
    assert after == {(1, 5): 5, (1, 1): 3, (2, 5): None}


def test_ema_against_numpy(spark):
    closes = [float(x) for x in np.random.default_rng(3).normal(100, 5, 40)]

    def ema(x, n):
        out = [x[0]]
        for v in x[1:]:
            out.append(out[-1] + (v - out[-1]) * 2 / (n + 1))
        return np.array(out)

    dif = ema(closes, 12) - ema(closes, 26)
    got = technical.macd(bars(spark, closes))
    assert column(got, "dif") == pytest.approx(dif.tolist())
    assert column(got, "dea") == pytest.approx(ema(dif, 9).tolist())


def test_rsi_without_losses_is_100(spark):
    assert set(column(technical.rsi(bars(spark, [float(i) for i in range(20)])), "rsi")) == {100.0}
    assert technical.rsi(bars(spark, [1.0, 2.0])).count() == 0


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(float(a), float(b), 1.0, float(c)) for (a, b), c in zip(x, y)], "a double, b double, flat double, y double")
    got = {r["feature"]: r["beta"] for r in models.ridge(df, ["a", "b", "flat"], "y", 0.5).collect()}
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 0.5 * np.eye(2), z.T @ (y - y.mean()))
    assert [got["a"], got["b"]] == pytest.approx(want.tolist())
    assert got["flat"] == 0 and got["(intercept)"] == pytest.approx(y.mean())


def test_auc_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1), (0.2, 0)], "s double, y int")
    assert metrics.auc(df, "s", "y").first()["auc"] == pytest.approx((2 + 0.5 + 3) / 6)
    assert metrics.auc(df.where("y = 1"), "s", "y").first()["auc"] is None


def test_session_clock_skips_lunch(spark):
    rows = spark.createDataFrame([(570,), (685,), (700,), (785,), (899,), (1000,)], "m int")
    got = rows.select(session.elapsed(F.col("m")).alias("e"), session.hhmm(session.shifted(F.col("m"), 10)).alias("t")).collect()
    assert [(r["e"], r["t"]) for r in got] == [(0, "09:40"), (115, "13:05"), (120, "13:10"), (125, "13:15"), (239, None), (None, None)]


def test_capped_weights_against_loop(spark):
    scores = [50.0, 30.0, 10.0, 5.0, 5.0, -3.0]
    df = spark.createDataFrame([(i, date(2024, 1, 1), s) for i, s in enumerate(scores)], "code long, date date, score double")
    w = np.maximum(scores, 0) / sum(s for s in scores if s > 0)
    for _ in range(8):
        over, free = np.maximum(w - 0.3, 0).sum(), np.where(w < 0.3, w, 0)
        w = np.minimum(0.3, w + over * (free / free.sum() if free.sum() > 1e-12 else 0))
    assert column(portfolio.capped_weights(df, "score", 0.3), "weight") == pytest.approx(w.tolist())


def test_walk_waits_for_exits(spark):
    df = bars(spark, [10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0]).withColumn("score", F.lit(1.0))
    trades = backtest.walk(df, "score", 0.5, 2, 0.0, limit_pct=50).orderBy("date").collect()
    assert [(t["entry"], t["exit"]) for t in trades] == [(11.0, 13.0), (14.0, 16.0)]


def test_first_in_first_out(spark):
    day = lambda n: date(2024, 1, n)
    kind = "code long, id long, at date, quantity long"
    buys = spark.createDataFrame([(1, 1, day(1), 5), (1, 2, day(2), 5)], kind)
    sells = spark.createDataFrame([(1, 7, day(3), 4), (1, 8, day(4), 4), (1, 9, day(5), 9)], kind)
    got = sorted((r["buy_id"], r["sell_id"], r["quantity"]) for r in backtest.first_in_first_out(buys, sells).collect())
    assert got == [(1, 7, 4), (1, 8, 1), (2, 8, 3), (2, 9, 2)]


def test_sales_take_only_what_was_bought_on_an_earlier_day(spark):
    day = lambda n: date(2024, 1, n)
    kind = "code long, id long, at date, quantity long"
    buys = spark.createDataFrame([(1, 1, day(2), 3), (1, 2, day(5), 4), (1, 3, day(8), 9)], kind)
    # On day 2 nothing is sellable yet, day 3 finds three of five, day 5 nothing, day 6 four.
    sells = spark.createDataFrame([(1, 4, day(2), 1), (1, 5, day(3), 5), (1, 6, day(5), 2), (1, 7, day(6), 1), (1, 8, day(7), 9)], kind)
    got = sorted((r["buy_id"], r["sell_id"], r["quantity"]) for r in backtest.first_in_first_out(buys, sells).collect())
    assert got == [(1, 5, 3), (2, 7, 1), (2, 8, 3)]


def test_lag_features_use_partial_history(spark):
    df = bars(spark, [1.0, 2.0, -1.0, -2.0]).withColumn("y", F.col("close"))
    got = labels.lag_features(df, "y", 3)
    assert column(got, "lag1") == [None, 1.0, 2.0, -1.0]
    assert column(got, "streak") == [None, 1.0, 2.0, -1.0]
    assert column(got, "mean")[-1] == pytest.approx(2 / 3)
    assert math.isclose(column(got, "std")[2], 0.5)


def test_empty_frames(spark):
    none = spark.createDataFrame([], BARS)
    assert merge.upsert(none, none).count() == 0
    assert technical.macd(none).count() == 0
    assert xsec.day_cube(none, ["close"]).count() == 0
    assert asof.backward(none, none.select("code", F.col("date").alias("since")), "code", "date", "since").count() == 0


def test_covariance_helpers():
    from tidemark.operators import covariance

    m = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    assert np.linalg.eigvalsh(covariance.nearest_psd(m)).min() > 0
    c = np.array([[2.0, 0.5], [0.5, 1.0]])
    o = covariance.orthogonal(c)
    assert (o @ c @ o) == pytest.approx(np.eye(2), abs=1e-9)
    assert np.trace(covariance.shrunk(c, 0.3)) == pytest.approx(3.0)
    assert covariance.simulated_var(c, np.array([0.5, 0.5]), 0.05, n=200_000) == pytest.approx(-1.645, abs=0.03)


def test_headlines_late_and_bare(spark):
    from datetime import datetime

    from tidemark.operators import headlines

    rows = spark.createDataFrame(
        [
            (1, "a", datetime(2024, 1, 5, 9, 0), "timestamp", datetime(2024, 1, 5, 9, 1)),
            (1, "b", datetime(2024, 1, 5), "date_only", datetime(2024, 1, 5, 8, 0)),
            (1, "c", datetime(2024, 1, 5, 9, 0), "timestamp", datetime(2024, 1, 5, 10, 0)),
            (1, "a ", datetime(2024, 1, 4), "date_only", datetime(2024, 1, 4, 8, 0)),
            (2, None, None, None, None),
        ],
        "code long, title string, published_at timestamp, clock_quality string, fetched_at timestamp",
    )
    calendar = spark.createDataFrame([(date(2024, 1, 4),), (date(2024, 1, 5),), (date(2024, 1, 8),)], "date date")
    kept = headlines.unique(rows)
    assert kept.count() == 4
    days = {(r["code"], r["title"]): r["decision_date"] for r in headlines.decision_days(kept, calendar).collect()}
    assert days == {(1, "a"): date(2024, 1, 5), (1, "b"): date(2024, 1, 8), (1, "c"): date(2024, 1, 8), (2, None): None}


def test_flat_and_zero_series_do_not_divide_by_zero(spark):
    from tidemark.operators import packs

    flat = bars(spark, [2.0] * 8).unionByName(bars(spark, [0.0] * 8, code=2))
    last = packs.open_pack(flat, (5,), least=6).where("code = 1").orderBy("date").collect()[-1]
    assert last["CORR_5"] is None and last["RSQR_5"] == 0 and last["MA_5"] == pytest.approx(1)
    assert packs.open_pack(flat, (5,)).count() == 16
    assert packs.gap_pack(flat).count() == 16
    assert column(flat.select("*", P.corr(F.col("close"), F.col("volume"), 3).alias("x")), "x") == [None] * 16
    rows = flat.withColumn("y", F.col("close"))
    assert metrics.rank_ic(rows, "close", "y").count() == 8
    assert xsec.pair_correlations(flat, ["close", "volume"], 2).first()["r"] is None
    assert portfolio.tracking(flat, "close", "volume").first()["corr"] is None
    assert technical.rsi(flat, 3).count() > 0 and technical.kdj(flat, n=8).count() == 16 and technical.kdj(flat).count() == 0


def test_risk_covers_every_supplier(spark):
    from tests.conftest import SMALL

    from tidemark.plans import market_queries, registry, research_queries

    r = research_queries.returns(spark, SMALL)
    codes = {x["code"] for x in r.select("code").distinct().collect()}
    assert {x["code"] for x in registry.QUERIES["risk_tracking_codes"](spark, SMALL).collect()} == codes and len(codes) > 6
    assert market_queries.grouped(spark, SMALL, "n_nationkey").agg(F.sum("members")).first()[0] == r.count()
    for name in ("risk_contributions", "risk_contributions_nations"):
        held = registry.QUERIES[name](spark, SMALL).collect()
        assert sum(x["weight"] for x in held) == pytest.approx(1, abs=1e-6) and sum(x["share"] for x in held) == pytest.approx(1, abs=1e-5)


def test_every_window_of_the_open_pack_is_registered():
    from tidemark.plans import registry, series_queries  # noqa: F401

    assert {f"pack_open_{d}" for d in (5, 10, 20, 30, 60)} <= set(registry.QUERIES)
