"""Agreement of curves, series and tables against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import agreement

DAY = dt.date(2024, 1, 1)


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(days=i)


def curves(spark, n, seed=0, code="p"):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n) * 0.01
    a, b = np.cumprod(1 + base + rng.normal(size=n) * 0.004), np.cumprod(1 + base)
    return a, b, [(code, day(i), float(x), float(y), 1) for i, (x, y) in enumerate(zip(a, b))]


@pytest.mark.parametrize("n, window, step, least", [(100, 30, 5, 10), (47, 20, 7, 10), (12, 30, 5, 10), (10, 30, 5, 10), (9, 30, 5, 10), (61, 3, 1, 4)])
def test_rolling_agreement(spark, n, window, step, least):
    a, b, rows = curves(spark, n)
    rows += [("p", day(200), None, 1.0, 1), ("q", DAY, 0.0, 1.0, 1), *(("q", day(i), 1.0 + i % 3, 2.0, 1) for i in range(1, 20))]
    got = [r for r in agreement.rolling_agreement(spark.createDataFrame(rows, "code string, date date, a double, b double, n int").repartition(4), window, step, least).orderBy("window_end").collect()]
    assert {r.code for r in got} <= {"p"}  # q begins at 0
    x, y = a[1:] / a[:-1] - 1, b[1:] / b[:-1] - 1
    w, want = max(5, window), []
    if n >= max(3, least):
        for start in range(0, max(1, n - 1 - w + 1), step):
            end = min(start + w, n - 1)
            if end - start >= max(5, least - 1):
                u, v = x[start:end], y[start:end]
                want.append((day(start + 1), day(end), end - start, np.corrcoef(u, v)[0, 1], np.std(u - v, ddof=1) * 252**0.5 * 100))
    assert [(r.window_start, r.window_end, r.n_days) for r in got] == [t[:3] for t in want]
    assert [r.corr for r in got] == pytest.approx([t[3] for t in want], abs=6e-5) and [r.tracking_error_pct for r in got] == pytest.approx([t[4] for t in want], abs=6e-5)


def test_a_curve_that_stands_still_has_no_correlation(spark):
    rows = [("p", day(i), 5.0, 1.0 + 0.1 * i) for i in range(20)]
    got = agreement.rolling_agreement(spark.createDataFrame(rows, "code string, date date, a double, b double"), window=10).collect()
    assert got and all(r.corr is None and r.tracking_error_pct > 0 for r in got)
    summary = agreement.agreement_summary(agreement.rolling_agreement(spark.createDataFrame(rows, "code string, date date, a double, b double"), window=10)).first()
    assert summary.trend == "insufficient" and summary.corr_latest is None and summary.n_windows == len(got)


def test_summary_compares_halves(spark):
    rows = [(k, day(i), v, 2.0) for k, values in {"up": [0.1, 0.2, 0.5, 0.9, 0.8], "down": [0.9, 0.8, 0.1], "same": [0.5, 0.5, 0.5, 0.5], "few": [0.1, 0.9], "gap": [0.1, None, 0.9, 0.95]}.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "code string, window_end date, corr double, tracking_error_pct double")
    got = {r.code: (r.trend, r.corr_latest, r.n_windows) for r in agreement.agreement_summary(df).collect()}
    assert got == {"up": ("improving", 0.8, 5), "down": ("declining", 0.1, 3), "same": ("stable", 0.5, 4), "few": ("insufficient", 0.9, 2), "gap": ("improving", 0.95, 4)}


def plain_alert(values, window=5, threshold=0.1):
    if len(values) < max(4, 2 * window - 1):
        return "insufficient", 0
    w = max(3, window)
    recent, prior = values[-w:], values[-2 * w : -w] if len(values) >= 2 * w else values[:-w]
    rm, pm = np.mean(recent), np.mean(prior)
    rate = (pm - rm) / abs(pm) if abs(pm) >= 1e-12 else 0.0 if abs(rm - pm) < 1e-12 else 1.0 if rm < pm else -1.0
    falls = 0
    for i in range(len(values) - 1, 0, -1):
        if values[i] >= values[i - 1] - 1e-12:
            break
        falls += 1
    kind = "degrading" if falls >= 3 and rate > threshold else "improving" if rate < -threshold else "stable" if abs(rate) <= threshold else "marginal"
    return kind, falls


@pytest.mark.parametrize("higher", [True, False])
def test_alerts(spark, higher):
    rng = random.Random(1)
    series = {f"s{i}": [rng.uniform(0.5, 2) for _ in range(rng.randint(3, 14))] for i in range(30)} | {"fall": [10 - 0.5 * i for i in range(12)], "zero": [0.0] * 12, "flat": [1.0] * 12, "rise": [1.0 * i for i in range(1, 13)]}
    rows = [(k, day(i), v) for k, values in series.items() for i, v in enumerate(values)] + [("fall", day(99), None), ("fall", day(98), float("nan"))]
    got = {r.code: (r.alert, r.falls) for r in agreement.alerts(spark.createDataFrame(rows, "code string, date date, value double").repartition(3), higher_is_better=higher).collect()}
    assert got == {k: plain_alert([v if higher else -v for v in values]) for k, values in series.items()}


BARS = "code string, date date, open double, high double, low double, close double, volume double"


def bars(spark, series):
    return spark.createDataFrame([(k, day(i), x, x + 1, x - 1, x, v) for k, values in series.items() for i, x, v in values], BARS)


def test_suffix_starts(spark):
    whole = [(i, float(i % 4), None if i == 5 else 10.0) for i in range(12)]
    new = bars(spark, {k: whole for k in "abcdef"})
    stored = bars(spark, {"a": whole[5:], "b": whole[11:], "c": whole, "d": whole[4:7] + [(7, 3.0, 11.0)] + whole[8:], "e": whole[3:8], "g": whole})
    got = {r.code: (r.n, r.n_stored, r.start) for r in agreement.suffix_starts(new, stored).collect()}
    # d differs in the middle, e does not reach the end, f is not stored, g is stored only.
    assert got == {"a": (12, 7, 5), "b": (12, 1, 11), "c": (12, 12, 0), "d": (12, 8, None), "e": (12, 5, None)}


def test_series_under_the_wrong_code_go(spark):
    new = bars(spark, {"a": [(0, 10.0, 1.0), (1, 11.0, 1.0)], "b": [(0, 10.0, 1.0), (1, 50.0, 1.0)], "c": [(0, 10.0, 1.0), (1, 0.0, 1.0)], "d": [(1, 7.0, 1.0)]})
    stored = bars(spark, {"a": [(1, 11.2, 1.0), (0, 99.0, 1.0)], "b": [(1, 11.0, 1.0)], "c": [(0, 20.0, 1.0), (1, 20.0, 1.0)], "d": [(1, 0.0, 1.0)]})
    assert {r.code: r.stored_close for r in agreement.mismatched(new, stored).collect()} == {"b": 11.0, "c": 20.0}
    assert {r.code for r in agreement.without_mismatched(new, stored).collect()} == {"a", "d"}
    assert agreement.without_mismatched(new, stored.limit(0)).count() == new.count()


def test_coverage_of_a_universe(spark):
    present = spark.createDataFrame([(c, day(d), k) for c, d, k in [("a", 0, "oo"), ("a", 0, "oo"), ("b", 0, "oo"), ("z", 0, "oo"), ("a", 1, "oo"), ("a", 0, "tc"), (None, 0, "tc"), ("c", 5, "oo")]], "code string, date date, kind string")
    universe = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "code string")
    dates = spark.createDataFrame([(day(0),), (day(1),), (day(2),), (None,)], "date date")
    out = agreement.coverage(present, universe, dates, ["oo", "tc"], share=0.5)
    got = {(r.date, r.kind): (r.n, r.need, round(r.fraction, 4), r.ok) for r in out.collect()}
    assert got == {(day(0), "oo"): (2, 2, 0.6667, True), (day(1), "oo"): (1, 2, 0.3333, False), (day(2), "oo"): (0, 2, 0.0, False), (day(0), "tc"): (1, 2, 0.3333, False), (day(1), "tc"): (0, 2, 0.0, False), (day(2), "tc"): (0, 2, 0.0, False)}
    assert {r.kind: (r.n_days, r.date_from, r.date_to, r.sample) for r in agreement.gaps(out, sample=2).collect()} == {"oo": (2, day(1), day(2), [day(1), day(2)]), "tc": (3, day(0), day(2), [day(0), day(1)])}
    assert agreement.coverage(present, universe, dates.limit(0), ["oo"]).count() == 0
    assert agreement.coverage(present, universe.limit(0), dates, ["oo"]).where(F.col("ok")).count() == 0
