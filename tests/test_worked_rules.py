"""Rules worked out by hand or by loops, apart from the queries' SQL."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import BARS, bars, column
from tidemark.operators import covariance, merge, metrics, packs, scalars, session, technical, xsec


def random_bars(n: int, seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows, c = [], 50.0
    for i in range(n):
        o = c * (1 + rng.normal() / 50)
        c = o * (1 + rng.normal() / 50)
        rows.append((1, date(2024, 1, 1) + timedelta(i), o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(rng.integers(0, 6))))
    return rows


@pytest.mark.parametrize("d", [5, 20])
def test_open_pack_against_a_bar_appended_for_today(spark, d):
    rows = random_bars(66)
    got = packs.open_pack(spark.createDataFrame(rows, BARS), (d,)).orderBy("date").collect()
    assert all(r[f"MA_{d}"] is None for r in got[:60])
    for t in range(60, 66):
        # Yesterday's volume stands for today's, one unit for none; the days before keep theirs.
        o = np.array([r[2] for r in rows[: t + 1]])
        high, low = np.array([*[r[3] for r in rows[:t]], o[-1]]), np.array([*[r[4] for r in rows[:t]], o[-1]])
        v = np.array([*[r[6] for r in rows[:t]], rows[t - 1][6] or 1.0])
        move = np.append(0, o[1:] / o[:-1] - 1)
        change, growth = np.append(0, np.diff(v)), np.append(0, np.log(v[1:] / (v[:-1] + 1e-12) + 1))
        w, m, dv = v[-d:], move[-d:], change[-d:]
        x = got[t].asDict()
        expected = {
            "VMA": w.mean() / v[-1], "VSTD": w.std() / v[-1], "VROC": v[-d - 1] / (v[-2] + 1e-12), "VRAMA": w.mean() / (v[-2] + 1e-12) / (o[-d:].mean() / o[-1]), "VSUMP": dv[dv > 0].sum() / np.abs(dv).sum(), "VSUMN": -dv[dv < 0].sum() / np.abs(dv).sum(),
            "VSUMD": dv.sum() / np.abs(dv).sum(), "WVMA": (np.abs(m) * w).std() / (np.abs(m) * w).mean(), "CORR": np.corrcoef(o[-d:], np.log(w + 1))[0, 1], "CORD": np.corrcoef(m, growth[-d:])[0, 1], "QTLU": np.quantile(o[-d:], 0.8) / o[-1],
            "RANK": (o[-d:] < o[-1]).mean(), "IMAX": np.argmax(high[-d:]) / d, "IMIN": np.argmin(low[-d:]) / d, "RSQR": np.corrcoef(np.arange(d), o[-d:])[0, 1] ** 2,
        }
        for name, value in expected.items():
            assert x[f"{name}_{d}"] == pytest.approx(value, rel=1e-6), (t, name)


def test_gap_and_lag_packs_of_a_short_series(spark):
    rows = [(1, date(2024, 1, i + 1), o, o + 1, o - 1, o + 0.5, v) for i, (o, v) in enumerate([(10.0, 4.0), (11.0, 2.0), (12.0, 6.0), (11.0, 8.0), (13.0, 2.0), (14.0, 5.0), (15.0, 3.0)])]
    df = spark.createDataFrame(rows, BARS)
    g = packs.gap_pack(df).orderBy("date").collect()
    assert g[0]["GAP"] is None and g[1]["YOPEN_RET"] == 0 and g[1]["GAP_VS_OOMA5"] == pytest.approx(11 / 10.5 - 1)
    assert g[6]["GAP"] == pytest.approx(15 / 14.5 - 1) and g[6]["OPEN_IN_YRANGE"] == pytest.approx((15 - 13) / 2) and g[6]["ABOVE_YHIGH"] == 0
    moves = [12 / 11 - 1, 11 / 12 - 1, 13 / 11 - 1, 14 / 13 - 1]
    assert g[6]["GAP_VS_OOMA5"] == pytest.approx(15 / 14.5 - 1 - np.mean([11 / 10 - 1, *moves]))
    ranges = [max(2, abs(a + 1 - b), abs(a - 1 - b)) / b for a, b in [(11, 10.5), (12, 11.5), (11, 12.5), (13, 11.5), (14, 13.5)]]
    assert g[6]["GAP_ATR"] == pytest.approx((15 / 14.5 - 1) / np.mean(ranges)) and g[6]["YVOL_Z20"] == 0
    lag = packs.lag_pack(df).orderBy("date").collect()
    assert lag[4]["OO_LAG1"] is None and lag[5]["OO_LAG1"] == pytest.approx(14 / 13 - 1)
    assert lag[6]["OO_MA5"] == pytest.approx(np.mean([*moves, 15 / 14 - 1])) and lag[6]["OO_MA10"] is None and lag[6]["VOL_SHOCK"] == pytest.approx(1)
    assert lag[6]["MOM3_C"] == pytest.approx(14.5 / 12.5 - 1)
    k = packs.candle_pack(df).orderBy("date").collect()[1]
    assert (k["YKMID"], k["YKMID2"], k["YKUP2"], k["YKLOW2"]) == pytest.approx((0.05, 0.25, 0.25, 0.5))


def test_kdj_begins_with_fifty(spark):
    df = bars(spark, [float(x) for x in (1, 2, 3, 2, 1, 4, 5, 6, 7)])
    k, d = column(technical.kdj(df), "k"), column(technical.kdj(df), "d")
    assert k[0] == d[0] == 50 and k[1] == pytest.approx(2 / 3 * 50 + 100 / 3) and d[1] == pytest.approx(2 / 3 * 50 + k[1] / 3)


def test_rsi_begins_after_the_first_average(spark):
    closes = [10.0, 11.0, 10.5, 11.5, 12.0, 11.0, 11.2, 11.4, 11.1, 11.3, 11.9, 12.3, 12.1, 12.4, 12.6, 12.2, 12.9]
    got = column(technical.rsi(bars(spark, closes)), "rsi")
    moves = np.diff(closes)
    gain, loss = np.maximum(moves, 0)[:14].mean(), np.maximum(-moves, 0)[:14].mean()
    want = []
    for m in moves[14:]:
        gain, loss = (gain * 13 + max(m, 0)) / 14, (loss * 13 + max(-m, 0)) / 14
        want.append(100 - 100 / (1 + gain / loss))
    assert got == pytest.approx(want) and len(got) == 2


def test_kelly_is_half_within_bounds(spark):
    rows = spark.createDataFrame([(0.55, 1.0), (0.6, 2.0), (0.9, 9.0), (0.0, 2.0), (0.5, None)], "p double, b double")
    got = [r["k"] for r in rows.select(scalars.kelly(F.col("p"), F.col("b")).alias("k")).collect()]
    assert got == pytest.approx([0.05, 0.2, 0.25, 0.15, 0.15])


def test_coverage_of_few_codes_needs_all(spark):
    two = bars(spark, [1.0] * 6).unionByName(bars(spark, [1.0] * 6, code=2, start=date(2024, 1, 3)))
    assert sorted(r["date"].day for r in merge.coverage(two).collect()) == [3, 4, 5, 6]
    apart = bars(spark, [1.0] * 2).unionByName(bars(spark, [1.0] * 2, code=2, start=date(2024, 2, 1)))
    assert merge.coverage(apart).count() == 4
    five = apart.unionByName(bars(spark, [1.0], code=3)).unionByName(bars(spark, [1.0], code=4)).unionByName(bars(spark, [1.0], code=5))
    assert [r["date"] for r in merge.coverage(five).collect()] == [date(2024, 1, 1)]


def test_quality_levels(spark):
    near = [(1, date(2024, 1, 1) + timedelta(i), 100.0 + i * 1.00005, 0.0, 0.0, 101.0 + i, 1.0) for i in range(30)]
    df = spark.createDataFrame(near, BARS)
    assert merge.quality(df, "2024-01-31").first()["level"] == "thin"  # opens repeat the last close to 0.01 per cent
    moved = df.withColumn("open", F.col("open") * 1.01)
    assert merge.quality(moved, "2024-01-31").first()["level"] == "good"
    assert merge.quality(moved, "2024-02-20").first()["level"] == "thin"
    assert merge.quality(moved, "2024-01-31", source="quote_fallback").first()["level"] == "empty"
    assert merge.quality(moved.limit(9), "2024-01-05").first()["level"] == "thin"


def test_session_has_no_time_outside(spark):
    rows = spark.createDataFrame([(569,), (570,), (690,), (700,), (900,), (901,)], "m int")
    got = rows.select(session.elapsed(F.col("m")).alias("e"), session.remaining(F.col("m")).alias("r"), session.crosses_lunch(F.col("m"), 30).alias("x")).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (0, 240, False), (120, 120, True), (120, 120, True), (240, 0, None), (None, None, None)]


def test_ic_summary_needs_three_days(spark):
    rows = spark.createDataFrame([(0.1, 5), (0.3, 6)], "rank_ic double, n long")
    assert metrics.ic_summary(rows).first().asDict() == {"days": 2, "mean_ic": None, "ic_std": None, "ic_ir": None, "positive": None, "max_names": 6}
    three = rows.unionByName(spark.createDataFrame([(-0.1, 4)], "rank_ic double, n long"))
    got = metrics.ic_summary(three).first()
    assert got["ic_std"] == pytest.approx(np.std([0.1, 0.3, -0.1]), abs=5e-5) and got["ic_ir"] == pytest.approx(0.1 / np.std([0.1, 0.3, -0.1]), abs=5e-5)


def test_weights_of_covariance_count_periods(spark):
    # A Friday and the Monday after it are one period apart.
    rows = spark.createDataFrame([(1, date(2024, 1, 5), 0.1), (1, date(2024, 1, 8), 0.4)], "code long, date date, ret double")
    mean = (0.5 * 0.1 + 0.4) / 1.5
    assert covariance.ewma(rows, 1.0, least=2).first()["cov"] == pytest.approx((0.5 * (0.1 - mean) ** 2 + (0.4 - mean) ** 2) / 1.5)
    assert covariance.ewma(rows, 1.0).count() == 0


def test_names_of_further_columns_do_not_clash(spark):
    df = bars(spark, [1.0, 2.0]).withColumns({c: F.lit("kept") for c in ("source", "place", "n", "rank", "peer_of")})
    got = merge.upsert(df, df.withColumn("close", F.col("close") + 1))
    assert got.columns == df.columns and column(got, "close") == [2.0, 3.0] and set(column(got, "place")) == {"kept"}
    twice = merge.upsert(df, df.unionByName(df.withColumn("close", F.lit(9.0))))
    assert twice.count() == 2
    peers = xsec.less_peers(df.withColumn("sector", F.lit("a")), "close", "sector")
    assert set(r["n"] for r in peers.collect()) == {"kept"}
