"""Reports and gates against plain Python, hand-worked cases, empty tables, NULLs and ties."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates, reports, scalars, trends

DAY = dt.date(2024, 1, 1)


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(days=i)


def near(a, b, eps=1e-6):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < eps)


def curve(spark, values, code="p"):
    return spark.createDataFrame([(code, day(i), v, 1) for i, v in enumerate(values)], "code string, date date, equity double, n int")


@pytest.mark.parametrize(
    "values, reason, head, tail",
    [
        ([100, 110, 120, 130, 140, 150, 160, 150, 145, 140], "below_head", 60.0, -6.67),
        ([100, 100, 101, 102, 102, 102, 103, 103, 100, 100], "below_zero", 3.0, -2.91),
        ([100, 100, 101, 101, 101, 101, 101, 101, 102, 103], None, 1.0, 1.98),
        ([100, 90, 80], "too_short", None, None),
        ([0, 1, 2, 3, 4, 5], None, None, 25.0),
    ],
)
def test_split_curve(spark, values, reason, head, tail):
    values = [float(v) for v in values]
    (r,) = reports.split_curve(curve(spark, [*values, None, float("nan")]), "code").collect()
    if reason == "below_zero":  # 3 % up, then 2.9 % down: 5.9 points
        assert r.tail_pct - r.head_pct < -5
    assert (r.points, r.reason, r.failed) == (len(values), reason, reason is not None)
    assert near(r.head_pct, head, 0.006) and near(r.tail_pct, tail, 0.006)
    if head is not None:
        cut = max(1, int(len(values) * 0.7))

        def fall(part):
            peak, deepest = part[0], 0.0
            for v in part:
                peak = max(peak, v)
                deepest = max(deepest, (peak - v) / peak * 100)
            return deepest

        assert (r.head_points, r.tail_points) == (cut, len(values) - cut)
        assert near(r.head_drawdown_pct, fall(values[:cut]), 0.006) and near(r.tail_drawdown_pct, fall(values[cut:]), 0.006)


def test_split_curve_share_is_bounded(spark):
    c = curve(spark, [float(v) for v in range(1, 21)])
    assert [reports.split_curve(c, "code", tail=t).first().tail_points for t in (0.01, 0.9)] == [3, 10]
    assert reports.split_curve(c.limit(0), "code").count() == 0


def test_market_states(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for code, size, drift in (("a", 0.001, 0.0), ("b", 0.015, 0.006), ("c", 0.015, -0.006), ("d", 0.05, 0.0), ("e", 0.015, 0.0)):
        price, closes = 100.0, []
        for i in range(45):
            price *= 1 + rng.gauss(drift, size)
            closes.append(price)
            rows.append((code, day(i), price))
            w = closes[-20:]
            moves = [b / a - 1 for a, b in zip(w, w[1:])]
            if len(w) < 5:
                want[code, day(i)] = "unknown"
                continue
            vol, grown = statistics.pstdev(moves), w[-1] / w[0] - 1
            want[code, day(i)] = "high_vol" if vol >= 0.025 else "low_vol" if vol <= 0.01 else "trend_up" if grown >= 0.05 else "trend_down" if grown <= -0.05 else "chop"
    rows += [("z", day(i), v) for i, v in enumerate([0.0] * 6)] + [("z", day(9), None)]
    bars = spark.createDataFrame(rows, "code string, date date, close double").repartition(3)
    got = {(r.code, r.date): r.state for r in reports.market_states(bars, "code").collect()}
    assert {k: v for k, v in got.items() if k[0] != "z"} == want
    assert len(set(want.values())) == 6
    assert {got["z", day(i)] for i in range(6)} == {"unknown"}  # no change can be told from 0


def test_trades_by_state(spark):
    states = spark.createDataFrame([(day(0), "chop"), (day(1), "trend_up")], "date date, state string")
    t = spark.createDataFrame([(day(0), 2.0), (day(0), -1.0), (day(1), 5.0), (day(1), None), (day(7), 9.0)], "date date, ret_pct double")
    got = {r.state: (r.n, r.mean_pct, r.win_pct, r.total_pct) for r in reports.trades_by_state(t, states).collect()}
    assert got == {"chop": (2, 0.5, 50.0, 1.0), "trend_up": (1, 5.0, 100.0, 5.0)}


def test_sector_effects_add_up(spark):
    rng = random.Random(5)
    rows = [(day(rng.randrange(3)), rng.choice(["x", "y", "z", None]), rng.gauss(0, 3)) for _ in range(200)] + [(day(0), "x", None)]
    got = reports.sector_effects(spark.createDataFrame(rows, "date date, sector string, ret_pct double"), "sector", "date").collect()
    for d in {r.date for r in got}:
        mine = [r for r in got if r.date == d]
        legs = [x for x in rows if x[0] == d and x[2] is not None]
        overall = sum(x[2] for x in legs) / len(legs)
        assert near(sum(r.weight_pct for r in mine), 100) and near(sum(r.even_pct for r in mine), 100)
        for r in mine:
            own = [x[2] for x in legs if x[1] == r.sector]
            w, b, m = len(own) / len(legs), 1 / len({x[1] for x in legs}), sum(own) / len(own)
            assert near(r.allocation_pct, (w - b) * overall) and near(r.selection_pct, b * (m - overall)) and near(r.interaction_pct, (w - b) * (m - overall))


def test_score_spread(spark):
    rows = [("a", "k1", 1.0, 10.0), ("a", "k2", 1.0, 20.0), ("a", "k3", 3.0, 40.0), ("b", "k1", 1.0, 1.0), ("a", "k4", None, 99.0)]
    t = spark.createDataFrame(rows, "g string, code string, score double, ret_pct double")
    (r,) = reports.score_spread(t, "score", "g").collect()
    assert (r.g, r.n, r.low_pct, r.high_pct, r.spread_pct) == ("a", 3, 10.0, 30.0, 20.0)
    with pytest.raises(ValueError):
        reports.score_spread(t, "score")


def test_traded_amounts(spark):
    orders = spark.createDataFrame([("a", "buy", 100.0), ("a", "sell", -50.0), ("a", "buy", None), ("b", "sell", 10.0), ("c", "buy", 5.0)], "code string, side string, amount double")
    equity = spark.createDataFrame([("a", 1000.0), ("b", 0.0)], "code string, equity double")
    got = {r.code: tuple(r)[1:] for r in reports.traded_amounts(orders, equity, "code", limit_pct=7.4).collect()}
    assert got == {"a": (2, 1, 100.0, 50.0, 7.5, True), "b": (0, 1, 0.0, 10.0, None, False), "c": (1, 0, 5.0, 0.0, None, False)}


@pytest.mark.parametrize("by", [(), ("code",)])
def test_hit_rates_over_time(spark, by):
    rng = random.Random(11)
    t0 = dt.datetime(2024, 1, 3, 15, 30)
    rows = [(rng.choice(["a", None]), t0 + dt.timedelta(hours=rng.randrange(24 * 60)), rng.choice(["true_positive", "false_positive", "uncertain", None])) for _ in range(60)] + [("a", None, "true_positive")]
    got = reports.hit_rates_over_time(spark.createDataFrame(rows, "code string, ts timestamp, outcome string"), *by, days=5).collect()
    groups = defaultdict(list)
    for code, ts, outcome in rows:
        if ts is not None:
            groups[code if by else "all"].append((ts, outcome))
    want = []
    for key, log in groups.items():
        first, spans = min(t for t, _ in log), defaultdict(list)
        for t, o in log:
            spans[(t - first).days // 5].append(o)
        before = "none"
        for k in sorted(spans):
            hit, miss = spans[k].count("true_positive"), spans[k].count("false_positive")
            rate = round(hit / (hit + miss), 4) if hit + miss else None
            told = "insufficient" if before in ("none", None) or rate is None else "improving" if rate - before > 0.02 else "declining" if rate - before < -0.02 else "stable"
            want.append((key if by else None, (first + dt.timedelta(days=5 * k)).date(), len(spans[k]), hit + miss, rate, told))
            before = rate
    have = [(r.code if by else None, r.bucket_start, r.total, r.labelled, r.hit_rate, r.direction) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all((r.bucket_end - r.bucket_start).days == 5 for r in got)


def test_log_counts(spark):
    rows = [(dt.datetime(2024, 12, 30, 1), "x"), (dt.datetime(2025, 1, 1, 1), None), (None, "x")]
    got = {(r.name, r.value): r.n for r in reports.log_counts(spark.createDataFrame(rows, "ts timestamp, reason string"), "reason").collect()}
    assert got == {("reason", "x"): 2, ("reason", "unknown"): 1, ("day", "2024-12-30"): 1, ("day", "2025-01-01"): 1, ("day", "unknown"): 1, ("week", "2025-W01"): 2, ("week", "unknown"): 1}


def test_against_index_holds(spark):
    index = spark.createDataFrame([(day(i), float(100 + 10 * i)) for i in range(5)], "date date, close double")
    bars = spark.createDataFrame([("a", day(i)) for i in range(4)], "code string, date date")
    t = spark.createDataFrame([("a", day(0), 2, 30.0), ("a", day(1), 3, 10.0), ("a", day(3), 2, 99.0), ("a", day(4), 1, 99.0), ("a", day(0), 0, 99.0)], "code string, date date, hold int, ret_pct double")
    (r,) = reports.against_index_holds(bars, index, t).collect()
    assert (r.n, r.trade_pct) == (2, 20.0) and near(r.index_pct, (20.0 + 27.27) / 2)  # out: past the index's end, no bar, no hold


def test_calendar_day(spark):
    texts = ["2024-01-31", " 2024/01/31 10:00", "20240131", "20240131x", "2024-02-30", "2024-01/31", "d0", "", None, "18991231", "2024-1-31"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(gates.calendar_day(F.col("t"))).collect()]
    jan = dt.date(2024, 1, 31)
    assert got == [jan, jan, jan, jan, *[None] * 7]


def test_availability(spark):
    d = dt.date
    cases = [  # as_of, announced, valued, available -> since
        (d(2024, 3, 31), d(2024, 4, 20), None, None, d(2024, 4, 20)),
        (d(2024, 3, 31), d(2024, 4, 20), None, d(2024, 4, 22), d(2024, 4, 22)),
        (d(2024, 3, 31), None, None, d(2024, 4, 22), None),
        (d(2024, 3, 31), None, d(2024, 4, 5), None, d(2024, 4, 5)),
        (d(2024, 3, 31), None, d(2024, 3, 1), None, None),
        (d(2024, 3, 29), None, None, None, d(2024, 3, 29)),
        (d(2024, 3, 29), None, d(2024, 4, 5), None, d(2024, 4, 5)),
        (None, None, None, None, None),
    ]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, as_of date, announced date, valued date, available date, since date")
    got = gates.with_availability(rows).orderBy("i").collect()
    assert [r.available_as_of for r in got] == [x[-1] for x in cases]
    assert [r.unannounced for r in got] == [x[-1] is None for x in cases]
    with pytest.raises(ValueError):
        gates.with_availability(rows.withColumn("unannounced", F.lit(1)))


def test_known_points(spark):
    rng = random.Random(2)
    pts = [(rng.choice("abc"), day(rng.randrange(40)), day(rng.randrange(20, 60)) if rng.random() < 0.9 else None, rng.random()) for _ in range(60)]
    asked = [(c, day(rng.randrange(70))) for c in "abcd" for _ in range(10)]
    points = spark.createDataFrame(pts, "code string, as_of date, available_as_of date, x double")
    got = gates.known_points(spark.createDataFrame(asked, "code string, date date"), points).collect()
    assert len(got) == len(asked)
    for r in got:
        own = [p for p in pts if p[0] == r.code and p[2] is not None]
        before = [p for p in own if p[2] <= r.date]
        if before:
            best = max((p[2], p[1]) for p in before)
            assert (r.known, r.available_as_of, r.as_of, r.earliest_later) == (True, *best, None)
            assert r.x in [p[3] for p in before if (p[2], p[1]) == best]
        else:
            assert (r.known, r.as_of, r.earliest_later) == (False, None, min((p[2] for p in own), default=None))


def test_windows_and_future_rows(spark):
    bars = spark.createDataFrame([("a", day(i), float(i)) for i in range(8)] + [("b", day(0), 0.0)], "code string, date date, close double")
    asked = spark.createDataFrame([("a", day(1)), ("a", day(6)), ("a", day(6)), ("a", day(50)), ("b", day(0))], "code string, date date")
    got = sorted((r.code, r.as_of, r.close) for r in gates.windows_as_of(bars, asked, rows=3).collect())
    assert got == [("a", day(1), 0.0), ("a", day(1), 1.0), ("a", day(6), 4.0), ("a", day(6), 5.0), ("a", day(6), 6.0), ("b", day(0), 0.0)]
    mixed = spark.createDataFrame([("w", "2024-12-31", "20240115"), ("w", "20240110", "20240115"), ("w", "d0", "20240115"), ("v", "2024-12-31", "")], "w string, date string, as_of string")
    assert {r.w: (r.n, r.later, r.clean) for r in gates.future_rows(mixed, "w").collect()} == {"w": (3, 1, False), "v": (1, 0, True)}


ANOMALY = "id int, eod_as_of date, expected_as_of date, trade_day date, session string, live boolean, open double, prev_close double, gap_pct double, last_change double, tau_as_of string, s1 double, s2 double"


def test_anomalies(spark):
    good = (day(1), day(1), day(2), "intraday", False, 10.0, 9.5, 5.26, 5.3, "2024-01-03 10:00", 1.0, 1.0)
    names = [x.split()[0] for x in ANOMALY.split(", ")][1:]
    cases = [
        ({}, "", False, False, None),
        ({"eod_as_of": None}, "missing:eod_as_of", True, False, "missing:eod_as_of"),
        ({"eod_as_of": day(2)}, "pit:eod_as_of,pit:eod_intraday_leak", True, False, "pit:eod_as_of"),
        ({"open": None}, "missing:open_t", True, True, "missing:open_t"),
        ({"open": float("nan")}, "missing:open_t", True, True, "missing:open_t"),
        ({"prev_close": None}, "missing:prev_close", True, True, "missing:prev_close"),
        ({"gap_pct": None}, "missing:gap", True, True, "missing:gap"),
        ({"open": None, "session": "eod"}, "", False, False, None),
        ({"open": None, "session": "eod", "live": True}, "missing:open_t", True, True, "missing:open_t"),
        ({"tau_as_of": "2024-01-02 10:00"}, "pit:as_of_tau", False, True, "pit:as_of_tau"),
        ({"tau_as_of": "intraday"}, "", False, False, None),
        ({"last_change": 4.0}, "pit:last_change_vs_gap", True, False, "pit:last_change_vs_gap"),
        ({"s1": None}, "missing:sub_scores_sparse", False, False, None),
        ({"s1": None, "s2": None}, "missing:sub_scores", True, False, "missing:sub_scores"),
        (dict.fromkeys(names), "missing:eod_as_of,missing:sub_scores", True, False, "missing:eod_as_of"),
    ]
    rows = [(i, *(dict(zip(names, good)) | change).values()) for i, (change, *_) in enumerate(cases)]
    df = spark.createDataFrame(rows, ANOMALY).withColumns({"y": F.lit(1.0), "y_tau": F.lit(2.0)})
    marked = gates.anomalies(df, ("s1", "s2"))
    got = marked.orderBy("id").collect()
    assert [(",".join(r.issues), r.fatal_eod, r.fatal_tau, r.gate_reason) for r in got] == [x[1:] for x in cases]
    left = gates.without_spoilt(marked, ("y",), ("y_tau",)).orderBy("id").collect()
    assert [(r.y is None, r.y_tau is None, r.hard_reject) for r in left] == [(x[2], x[3], x[2]) for x in cases]
    assert gates.anomalies(df.limit(0)).count() == 0


def test_candidates(spark):
    rows = [("a", 2.0, False), ("b", 2.0, None), ("c", 9.0, True), ("d", 1.0, False), ("e", None, False), ("f", 0.5, False), ("g", 3.0, False)]
    df = spark.createDataFrame([(day(0), *r) for r in rows], "date date, code string, y double, hard_reject boolean")
    assert [(r.code, r.place) for r in gates.candidates(df, F.col("y"), 1.0, 3).orderBy("place").collect()] == [("g", 1), ("a", 2), ("b", 3)]


def plain_slots(ranked, positions, per_sector):
    taken, held, out = [], defaultdict(int), {}
    for code, sector in ranked:
        if len(taken) >= positions:
            out[code] = "max_positions"
        elif held[sector] >= per_sector:
            out[code] = "sector_slot_full"
        else:
            out[code] = None
            taken.append(code)
            held[sector] += 1
    return taken, out


@pytest.mark.parametrize("seed", range(4))
def test_slots_and_parity(spark, seed):
    rng = random.Random(seed)
    rows = [(day(0), f"c{i:02d}", rng.choice(["x", "y", "z", None]), float(rng.randrange(12)), rng.choice([0.1, 0.2, 0.4, 2.0, 90.0, None, 0.0])) for i in range(30)]
    positions, cap, sector_cap = rng.choice([4, 8, 12]), rng.choice([15.0, 25.0]), 30.0
    df = spark.createDataFrame(rows, "date date, code string, sector string, score double, vol double").repartition(3)
    marked = gates.slots(df, "score", "sector", positions, 3)
    ranked = sorted(rows, key=lambda r: (-r[3], r[1]))
    taken, why = plain_slots([(r[1], r[2]) for r in ranked], positions, 3)
    assert {r.code: r.skipped for r in marked.collect()} == why
    # Weights by the rule, one after the other.
    chosen = [r for r in ranked if r[1] in taken]
    inverse = {r[1]: 1 / r[4] if r[4] and r[4] > 1e-8 else 1.0 for r in chosen}
    want = {k: min(100.0, positions * cap) * v / sum(inverse.values()) for k, v in inverse.items()}
    held, weights = defaultdict(float), {}
    for r in sorted(chosen, key=lambda r: -inverse[r[1]]):  # stable: by rank
        take = min(want[r[1]], cap, sector_cap - held[r[2]])
        weights[r[1]] = round(take, 4) if take > 0.05 else 0.0
        held[r[2]] = round(held[r[2]] + weights[r[1]], 4)
    got = {r.code: r.weight_pct for r in gates.parity_weights(marked, "vol", "score", "sector", cap, sector_cap, positions).collect()}
    assert got.keys() == weights.keys()
    assert all(near(got[k], weights[k], 2e-4) for k in got)


def test_inflow_scores(spark):
    rows = [("a", day(i), 10.0, 10.0, n) for i, n in enumerate([10.0, -100.0, 0.0, None])] + [("b", day(0), 0.0, 5.0, 900.0), ("b", day(1), 0.0, 5.0, -1.0)]
    got = [(r.ratio, r.score) for r in trends.inflow_scores(spark.createDataFrame(rows, "code string, date date, close double, volume double, net_inflow double")).orderBy("code", "date").collect()]
    assert got == [(0.1, round(50 + 35 * math.tanh(0.8), 1)), (-1.0, 20.0), (0.0, 50.0), (None, None), (None, 62.0), (None, 38.0)]


def test_variance_shares(spark):
    cases = [(4.0, 1.0, 100.0), (1.0, 4.0, 0.0), (1.0, 4.0, None), (0.0, 1.0, 0.0), (None, 1.0, 0.0), (1.0, 1.0, -100.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, a double, b double, r double")
    a, b = scalars.inverse_variance_shares(F.col("a"), F.col("b"), F.col("r"))
    got = [tuple(r) for r in df.orderBy("i").select(scalars.remaining_variance(F.col("b"), F.col("r")), a, b).collect()]
    assert [g[0] for g in got] == [0.25, 4.0, 4.0, 1.0, 1.0, 1.0]
    assert near(got[0][1], 0.25 / 4.25) and near(got[0][2], 4 / 4.25) and near(got[1][1], 0.8) and got[3][1:] == (None, None) and got[4][1:] == (None, None)
