"""One-to-one matching by time against picking the closest pair again and again."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendars, matching, measures, signals

T = dt.datetime(2024, 1, 1, 10)
LOG = "code string, ts timestamp, id long, note string"


def log(spark, rows):
    return spark.createDataFrame([(c, None if t is None else T + dt.timedelta(seconds=t), i, "x") for i, (c, t) in enumerate(rows)], LOG)


def closest_first(a, b, tolerance):
    """Distances of the pairs of each code, the closest taken first."""
    out = []
    for code in {c for c, _ in a}:
        x, y = [t for c, t in a if c == code and t is not None], [t for c, t in b if c == code and t is not None]
        while x and y:
            d, s, t = min((abs(s - t), s, t) for s in x for t in y)
            if d > tolerance:
                break
            out.append((code, d))
            x.remove(s)
            y.remove(t)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_are_the_closest_and_used_once(spark, seed):
    rng = random.Random(seed)
    # Distances differ, so that the order of picks is the only one.
    times = rng.sample([2**k % 9973 for k in range(9000)], 60)
    times = list(dict.fromkeys(times))
    a = [(rng.choice("pq"), t) for t in times[::2]] + [("p", None), (None, 5)]
    b = [(rng.choice("pq"), t) for t in times[1::2]] + [("p", None)]
    got = matching.matched(log(spark, a).repartition(3), log(spark, b), ["code"], tolerance=150).collect()
    assert len({r.left for r in got}) == len({r.right for r in got}) == len(got)
    assert all(abs(a[r.left][1] - b[r.right][1]) == r.seconds <= 150 and a[r.left][0] == b[r.right][0] == r.code for r in got)
    want = closest_first(a, b, 150)
    assert sum(r.seconds for r in got) == sum(d for _, d in want) and len(got) == len(want)


def test_ties_and_repeats(spark):
    # 10 lies between 9 and 11: the earlier goes; the later label then finds 20 too far.
    pairs = {(r.left, r.right) for r in matching.matched(log(spark, [("a", 10)]), log(spark, [("a", 11), ("a", 9)]), ["code"], 5).collect()}
    assert pairs == {(0, 1)}
    same = matching.matched(log(spark, [("a", 5)] * 3), log(spark, [("a", 5)] * 2), ["code"], 0).collect()
    assert len(same) == 2 and len({r.left for r in same}) == len({r.right for r in same}) == 2
    assert matching.matched(log(spark, [("a", 0)]), log(spark, [("a", 301)]), ["code"]).count() == 0
    assert matching.matched(log(spark, []), log(spark, [("a", 1)]), ["code"]).count() == 0
    # Distances that fall along a chain: one pair a round, all pairs in the end.
    chain = [0, 100, 190, 270, 340, 400, 450, 490]
    got = matching.matched(log(spark, [("a", t) for t in chain[::2]]), log(spark, [("a", t) for t in chain[1::2]]), ["code"]).collect()
    assert len(got) == 4


def test_labelled_entries_and_their_rates(spark):
    entries = log(spark, [("a", 0), ("a", 1000), ("a", 2000), ("b", 0), ("b", 9000)]).withColumn("reason", F.when(F.col("id") < 2, "limit").otherwise("halt"))
    labels = log(spark, [("a", 10), ("a", 2100), ("b", 100), ("b", 5000)]).withColumn("outcome", F.element_at(F.array(*map(F.lit, ["true_positive", "false_positive", "uncertain", "true_positive"])), (F.col("id") + 1).cast("int")))
    out = matching.labelled(entries, labels, ["code"])
    assert {r.id: r.outcome for r in out.collect()} == {0: "true_positive", 1: None, 2: "false_positive", 3: "uncertain", 4: None}
    got = {r.reason: r for r in matching.effectiveness(out, "reason").collect()}
    assert got["limit"][1:] == (2, 1, 1, 0, 0, 1.0, 0.0, 0.5)
    assert got["halt"][1:] == (3, 1, 0, 1, 1, 0.0, 1.0, 0.3333)


def test_trading_days_n_steps_away(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 5), 2), (dt.date(2024, 1, 7), 3), (None, 4)], "date date, id int")
    got = {r.id: (r.next, r.previous) for r in calendars.neighbours(rows, ["2024-01-08"], 3).collect()}
    # Friday the 5th: Tuesday, Wednesday, Thursday; before it Thursday, Wednesday, Tuesday.
    assert got[1] == got[2] == (dt.date(2024, 1, 11), dt.date(2024, 1, 2))
    assert got[3] == (dt.date(2024, 1, 11), dt.date(2024, 1, 3)) and got[4] == (None, None)
    assert calendars.neighbours(rows, [], 400).where("id = 1").first().next == dt.date(2025, 7, 18)


def test_columns_that_would_be_overwritten_are_refused(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 5), 1.0, "x", 1, 1, 1)], "code string, date date, v double, sector string, tier int, weight int, next int").withColumn("part", F.lit(1))
    for fails in (lambda: signals.tiers(rows, "v"), lambda: signals.split_rows(rows), lambda: calendars.neighbours(rows, []), lambda: measures.capped_parity(rows, "v", "sector", 0.5, 0.5)):
        with pytest.raises(ValueError, match="already"):
            fails()
