"""Rules worked out by hand or by plain Python: halts, limits, labels, stops, and the pack at clocks."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clock_pack, measures, scalars, session, signals, trends

DAY = dt.date(2024, 1, 1)
BARS = "code string, date date, open double, high double, low double, close double, volume double"


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(days=i)


def test_halted_bars_by_volume_and_words(spark):
    rows = [("a", 0.0, "x", None), ("a", None, "x", None), ("a", -1.0, None, "halt"), ("a", 5.0, "Suspended", None), ("a", 5.0, None, "is suspended"), ("a", 5.0, "停牌", "y"), ("a", 5.0, None, None)]
    bars = spark.createDataFrame(rows, "code string, volume double, status string, remark string")
    kept, audit = measures.without_halted(bars, ("status", "remark"))
    assert kept.count() == 3
    assert audit.first() == ("a", 3, 2, 2)


def test_limits_by_board_and_name(spark):
    rows = [("600001", "Alpha", 9.5), ("300001", "Alpha", 19.5), ("688001", None, 19.5), ("300001", "*ST x", 4.5), ("600001", "S T", 4.5), ("600001", "退 x", 4.5)]
    df = spark.createDataFrame(rows, "code string, name string, want double")
    assert all(r.got == r.want for r in df.select("want", scalars.limit_pct(F.col("code"), F.col("name")).alias("got")).collect())


def test_reversal_counts_limits_of_its_own_board(spark):
    closes = [100.0, 106.0, 112.0, 124.0, 150.0, 150.0]
    bars = spark.createDataFrame([(code, day(i), x, x, x, x, 1.0) for code in ("600001", "300001", "600002") for i, x in enumerate(closes)], BARS).withColumn("name", F.when(F.col("code") == "600002", "ST b"))
    out = trends.reversal_scores(bars, scalars.limit_pct(F.col("code"), F.col("name"))).where(F.col("date") == F.lit(day(5)))
    # Changes: 6, 5.7, 10.7 and 21 per cent.
    assert {r.code: (r.limit_ups, r.limit_run) for r in out.collect()} == {"600001": (2, 2), "300001": (1, 1), "600002": (4, 4)}


def test_labels_of_repeated_slots_take_the_first(spark):
    at = lambda h, m, s=0: dt.datetime(2024, 1, 2, h, m, s)
    rows = [("a", at(10, 0, 30), 99.0), ("a", at(10, 0), 12.0), ("a", at(10, 0), 10.0), ("a", at(10, 25), 11.0), ("a", at(14, 0), None), ("a", at(15, 0), 20.0), ("b", at(10, 25), 0.0)]
    slots = spark.createDataFrame([(c, t.date(), t, x, "z") for c, t, x in rows], "code string, date date, slot timestamp, close double, minute string")
    out = session.label_prices(slots, [600, 605], (25,)).collect()
    assert {(r.code, r.tau): (r.price, r.end_price, r.y_close and round(r.y_close, 6)) for r in out} == {("a", 600): (10.0, 11.0, 100.0), ("a", 605): (None, None, None)}


def test_stops_of_a_position(spark):
    bars = spark.createDataFrame([("a", day(i), x, x + 1, x - 1, x, 1.0) for i, x in enumerate([50.0, 10.0, 12.0, 11.0])], BARS)
    whole = {r.date: r for r in signals.stops(bars).collect()}
    assert whole[day(3)].trailing_stop == 45.0 and whole[day(0)].range_stop is None
    own = {r.date: r for r in signals.stops(bars, entry=F.lit(9.5), since=F.lit(day(1))).collect()}
    assert own[day(0)].trailing_stop is None and own[day(0)].range_stop is None
    assert own[day(3)].trailing_stop == 10.8
    # True ranges: 41, 3 and 2.
    assert own[day(3)].range_stop == round(9.5 - 2 * (41 + 3 + 2) / 3, 4)


def test_combined_score_has_one_place(spark):
    rng = random.Random(2)
    bars = spark.createDataFrame([("a", day(i), x, x + 1, x - 1, x, rng.uniform(1, 9)) for i, x in enumerate(50 + 9 * math.sin(i / 3) for i in range(60))], BARS)
    scores = [r.score for r in signals.combined(bars).collect()]
    assert len(scores) == 31 and all(x == round(x, 1) for x in scores)


# The pack at clocks.


def pack_by_hand(rows, p, hi, lo, volume, d):
    """The fields of one window, the bar of the clock appended to the days before (open, high, low, close, volume)."""
    o = rows[-1][0]
    past = rows[:-1]
    v_last = past[-1][4]
    price = np.array([r[3] for r in past] + [p])
    high, low = np.array([r[1] for r in past] + [max(hi, o, p)]), np.array([r[2] for r in past] + [min(lo, o, p)])
    vol = np.array([r[4] for r in past] + [volume if volume > 0 else v_last or 1.0])
    ret, dv = price[1:] / price[:-1] - 1, np.diff(vol)
    seg, hs, ls, vs, rs = price[-d:], high[-d:], low[-d:], vol[-d:], ret[-d:]
    slope, level = np.polyfit(np.arange(d), seg, 1)
    w = np.abs(rs) * vs
    return {
        "ROC": price[-d - 1] / p, "MA": seg.mean() / p, "STD": seg.std() / p, "BETA": slope / p, "RESI": (p - (level + slope * (d - 1))) / p, "RSQR": np.corrcoef(np.arange(d), seg)[0, 1] ** 2, "MAX": hs.max() / p, "LOW": ls.min() / p,
        "QTLU": np.quantile(seg, 0.8) / p, "QTLD": np.quantile(seg, 0.2) / p, "RANK": (seg < p).sum() / d, "RSV": (p - ls.min()) / (hs.max() - ls.min()), "IMAX": hs.argmax() / d, "IMIN": ls.argmin() / d, "CORR": np.corrcoef(seg, np.log(vs + 1))[0, 1],
        "CNTP": (rs > 0).mean(), "SUMN": -rs[rs < 0].sum() / np.abs(rs).sum(), "VMA": vs.mean() / vol[-1], "VSTD": vs.std() / vol[-1], "WVMA": w.std() / w.mean(), "VSUMP": dv[-d:][dv[-d:] > 0].sum() / np.abs(dv[-d:]).sum(), "VROC": vol[-d - 1] / v_last, "VRAMA": (vs.mean() / v_last) / (seg.mean() / p),
    }


@pytest.fixture(scope="module")
def clocks(spark):
    rng = random.Random(4)
    rows = {}
    for code in "ab":
        x = 50.0
        for i in range(66):
            o = x * rng.uniform(0.97, 1.03)
            x = o * rng.uniform(0.97, 1.03)
            rows[code, i] = (o, max(o, x) * rng.uniform(1, 1.02), min(o, x) * rng.uniform(0.98, 1), x, float(rng.randint(1, 900)))
    bars = spark.createDataFrame([(c, day(i), *r, "t") for (c, i), r in rows.items()], BARS + ", tau string")
    slots = [("a", day(65), 575, 61.0, 60.0, 60.5, 5.0), ("a", day(65), 580, 62.0, 59.0, 61.5, 7.0), ("a", day(65), 600, 70.0, 58.0, 66.0, 8.0), ("a", day(65), 610, None, None, None, 9.0), ("a", day(65), 615, 80.0, 1.0, 0.0, 1.0), ("a", day(64), 700, 55.0, 50.0, 52.0, 1.0)]
    slots = spark.createDataFrame([(*s, "m") for s in slots], "code string, date date, minute int, high double, low double, close double, volume double, price string")
    out = clock_pack.clock_pack(bars, slots, [clock_pack.AT_OPEN, 575, 590, 620], windows=(5, 20, 60)).collect()
    return rows, {(r.code, r.date, r.tau): r.asDict() for r in out}


@pytest.mark.parametrize("tau, prefix", [(0, None), (575, (60.5, 61.0, 60.0, 5.0)), (590, (61.5, 62.0, 59.0, 12.0)), (620, (66.0, 70.0, 58.0, 20.0))])
def test_clock_pack_equals_an_appended_bar(clocks, tau, prefix):
    rows, out = clocks
    history = [rows["a", i] for i in range(66)]
    o = history[-1][0]
    p, hi, lo, volume = prefix or (o, o, o, 0.0)
    for d in (5, 20, 60):
        for name, want in pack_by_hand(history, p, hi, lo, volume, d).items():
            assert out["a", day(65), tau][f"P{name}_{d}"] == pytest.approx(want, rel=1e-6, abs=1e-9), (name, d)


def test_clock_pack_prefix_and_gaps(clocks):
    rows, out = clocks
    o, c = rows["a", 65][0], rows["a", 64][3]
    at = out["a", day(65), 620]
    assert at["RANGE_PCT"] == pytest.approx(12 / o) and at["LOC_HL"] == pytest.approx(8 / 12) and at["PULLBACK"] == pytest.approx(4 / 70) and at["PATH_SIGN"] == -1.0
    assert at["RET_LAST_15M"] == pytest.approx(66 / 60.5 - 1) and at["REALIZED_VOL"] == pytest.approx(np.std([61.5 / 60.5 - 1, 66 / 61.5 - 1], ddof=1)) and at["VOL_LAST3_VS_AVG"] == pytest.approx(1)
    assert at["RET_OT"] == pytest.approx(66 / o - 1) and at["RET_PT"] == pytest.approx(66 / c - 1) and at["GAP"] == pytest.approx(o / c - 1) and at["TAU_ELAPSED_MIN"] == 50
    neutral = out["b", day(65), 590]
    assert {k: neutral[k] for k in clock_pack.NEUTRAL} == clock_pack.NEUTRAL and neutral["RET_OT"] == pytest.approx(0) and neutral["TAU_IN_PREFIX"] == 0.5
    # A slot after the clock says nothing at it.
    assert out["a", day(64), 620]["RANGE_PCT"] == 0.0


def test_clock_pack_needs_its_history(clocks):
    _, out = clocks
    assert len(out) == 2 * 66 * 4
    assert out["a", day(59), 0]["GAP"] is None and out["a", day(60), 0]["GAP"] is not None and out["a", day(60), 0]["PMA_60"] is not None
    assert len(next(iter(out.values()))) == 3 + 69 + 3 * 31


def test_clock_pack_of_nothing_and_of_nulls(spark):
    slots = spark.createDataFrame([], "code string, date date, minute int, high double, low double, close double, volume double")
    assert clock_pack.clock_pack(spark.createDataFrame([], BARS), slots, [600]).count() == 0
    bars = spark.createDataFrame([("a", day(i), 1.0, 2.0, 0.5, None if i == 60 else 1.5, 3.0) for i in range(63)], BARS)
    out = {r.date: r for r in clock_pack.clock_pack(bars, slots, [600]).collect()}
    assert out[day(60)].GAP is not None and out[day(61)].GAP is None and out[day(62)].CC_LAG1 is None
