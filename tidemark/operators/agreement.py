"""Whether series agree: two curves over rolling windows, a series with its stored form, a table with what it should hold.

Rows with NULL, NaN or infinite values in what is compared are left out; entities with too few rows give none. One row for each code and date is
expected. Empty tables give empty results; further columns are ignored or, where rows are returned, kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel, finite

P = Panel()
#: Trading days of a year, and how far two closes of one day may be apart.
YEAR, APART = 252, 0.02


def rolling_agreement(curves: DataFrame, window: int = 30, step: int = 5, least: int = 10) -> DataFrame:
    """``code, window_start, window_end, n_days, corr, tracking_error_pct`` of the returns of two curves (code, date, a, b), for every ``step``-th window of ``window`` returns.

    A code needs ``least`` common dates and positive first values; with fewer returns than a window all of them are one, if there are ``least`` - 1. Sums run along the series once: a window's are the
    difference of two rows, however long it is. ``corr`` is NULL where a curve stands still.
    """
    window, step = max(5, window), max(1, step)
    whole = Window.partitionBy("code")
    both = curves.select("code", "date", finite(F.col("a").cast("double")).alias("a"), finite(F.col("b").cast("double")).alias("b")).where("a is not null and b is not null")
    both = both.withColumns({"__n": F.count("*").over(whole), "__first": F.min_by(F.least("a", "b"), "date").over(whole), "pa": F.lag("a").over(P.series), "pb": F.lag("b").over(P.series)})
    both = both.where((F.col("__n") >= max(3, least)) & (F.col("__first") > 0) & (F.col("pa") > 0) & (F.col("pb") > 0))
    r = both.select("code", "date", (F.col("a") / F.col("pa") - 1).alias("x"), (F.col("b") / F.col("pb") - 1).alias("y"))
    so_far = P.series.rowsBetween(Window.unboundedPreceding, 0)
    products = {"x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}
    r = r.withColumns({"i": F.row_number().over(P.series), "n": F.count("*").over(whole)} | {f"s_{k}": F.sum(v).over(so_far) for k, v in products.items()})
    before = {f"w_{k}": F.col(f"s_{k}") - F.coalesce(F.lag(f"s_{k}", window).over(P.series), F.lit(0.0)) for k in products}
    r = r.withColumns(before | {"start": F.coalesce(F.lag("date", window - 1).over(P.series), F.first("date").over(so_far)), "k": F.least(F.col("i"), F.lit(window))})
    ends = ((F.col("i") >= window) & ((F.col("i") - window) % step == 0)) | ((F.col("n") < window) & (F.col("i") == F.col("n")) & (F.col("n") >= max(5, least - 1)))
    k = F.col("k")
    moment = lambda a, b: F.col(f"w_{''.join(sorted(a + b))}") - F.col(f"w_{a}") * F.col(f"w_{b}") / k
    vx, vy, xy = moment("x", "x"), moment("y", "y"), moment("x", "y")
    corr = F.when((vx > 1e-18) & (vy > 1e-18), xy / F.sqrt(vx * vy))
    error = F.sqrt(F.greatest(vx + vy - 2 * xy, F.lit(0.0)) / (k - 1)) * math.sqrt(YEAR) * 100
    return r.where(ends).select("code", F.col("start").alias("window_start"), F.col("date").alias("window_end"), k.cast("int").alias("n_days"), F.round(corr, 4).alias("corr"), F.round(error, 4).alias("tracking_error_pct"))


def agreement_summary(windows: DataFrame) -> DataFrame:
    """``code, n_windows, corr_latest, corr_mean, te_latest, te_mean, trend``: ``trend`` compares the mean correlation of the later half of the windows with the earlier one's."""
    order = Window.partitionBy("code").orderBy("window_end")
    known = windows.withColumns({"i": F.count("corr").over(order.rowsBetween(Window.unboundedPreceding, 0)), "m": F.count("corr").over(Window.partitionBy("code"))})
    late = F.col("i") > F.floor(F.col("m") / 2)
    g = known.groupBy("code").agg(
        F.count("*").alias("n_windows"), F.max_by("corr", F.when(F.col("corr").isNotNull(), F.col("window_end"))).alias("corr_latest"), F.avg("corr").alias("corr_mean"), F.max_by("tracking_error_pct", "window_end").alias("te_latest"), F.avg("tracking_error_pct").alias("te_mean"),
        F.max("m").alias("m"), (F.avg(F.when(late, F.col("corr"))) - F.avg(F.when(~late, F.col("corr")))).alias("up"),
    )
    trend = F.when(F.col("m") < 3, "insufficient").when(F.abs("up") < 1e-6, "stable").when(F.col("up") > 0, "improving").otherwise("declining")
    return g.select("code", "n_windows", "corr_latest", "corr_mean", "te_latest", "te_mean", trend.alias("trend"))


def alerts(series: DataFrame, window: int = 5, threshold: float = 0.1, higher_is_better: bool = True) -> DataFrame:
    """``code, alert, recent_mean, prior_mean, decline_rate, falls`` of a measure (code, date, value): the mean of the newest values against those before, and how many fell one after the other up to now."""
    w = max(3, window)
    back = Window.partitionBy("code").orderBy(F.desc("date"))
    v = finite(F.col("value").cast("double"))
    rows = series.select("code", "date", (v if higher_is_better else -v).alias("v")).where("v is not null")
    rows = rows.withColumns({"k": F.row_number().over(back) - 1, "fell": F.coalesce(F.col("v") < F.lag("v").over(P.series) - 1e-12, F.lit(False))})
    g = rows.groupBy("code").agg(F.count("*").alias("n"), F.avg(F.when(F.col("k") < w, F.col("v"))).alias("recent"), F.avg(F.when((F.col("k") >= w) & (F.col("k") < 2 * w), F.col("v"))).alias("prior"), F.min(F.when(~F.col("fell"), F.col("k"))).alias("falls"))
    enough = (F.col("n") >= max(4, 2 * window - 1)) & F.col("prior").isNotNull()
    flat = F.abs("prior") < 1e-12
    rate = F.when(flat, F.when(F.abs(F.col("recent") - F.col("prior")) < 1e-12, 0.0).when(F.col("recent") < F.col("prior"), 1.0).otherwise(-1.0)).otherwise((F.col("prior") - F.col("recent")) / F.nullif(F.abs("prior"), F.lit(0.0)))
    g = g.withColumn("rate", F.when(enough, rate))
    kind = F.when(~enough, "insufficient").when((F.col("falls") >= 3) & (F.col("rate") > threshold), "degrading").when(F.col("rate") < -threshold, "improving").when(F.abs("rate") <= threshold, "stable").otherwise("marginal")
    there = lambda x, digits: F.when(enough, F.round(x, digits))
    return g.select("code", kind.alias("alert"), there("recent", 6).alias("recent_mean"), there("prior", 6).alias("prior_mean"), there("rate", 4).alias("decline_rate"), F.when(enough, F.col("falls")).otherwise(F.lit(0)).alias("falls"))


def _mark(values: tuple[str, ...]) -> Column:
    """A number for a row and its place from the end; sums of them stand for the end of a series."""
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    return F.xxhash64(place, "date", *values).cast("decimal(38,0)")


def suffix_starts(bars: DataFrame, stored: DataFrame, values: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """``code, n, n_stored, start``: how many of a code's bars come before those that are stored, if these are its end exactly; else NULL.

    A running sum from the end backwards stands for every suffix, so that the one that equals the stored series is found by one equi-join. Series of no more bars than are stored have
    start 0 if they are equal.
    """
    back = Window.partitionBy("code").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    own = bars.select("code", "date", _mark(values).alias("m")).select("code", F.sum("m").over(back).alias("mark"), F.count("*").over(back).alias("length"))
    old = stored.select("code", _mark(values).alias("m")).groupBy("code").agg(F.sum("m").alias("mark"), F.count("*").alias("length"))
    total = own.groupBy("code").agg(F.max("length").alias("n"))
    found = own.join(old, ["code", "mark", "length"], "left_semi").select("code", F.lit(True).alias("found"))
    joined = total.join(old.select("code", F.col("length").alias("n_stored")), "code").join(found, "code", "left")
    return joined.select("code", "n", "n_stored", F.when(F.col("found"), F.col("n") - F.col("n_stored")).alias("start"))


def mismatched(bars: DataFrame, stored: DataFrame, apart: float = APART) -> DataFrame:
    """``code, date, close, stored_close`` of codes whose last positive close is more than ``apart`` from the stored one of that day: another series under the same code."""
    last = bars.where("close > 0 and date is not null").groupBy("code").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    both = last.join(stored.where("close > 0").select("code", "date", F.col("close").alias("stored_close")), ["code", "date"])
    far = F.abs(F.col("close") - F.col("stored_close")) / F.greatest(F.abs("close"), F.abs("stored_close"), F.lit(1e-9))
    return both.where(far > apart)


def without_mismatched(bars: DataFrame, stored: DataFrame, apart: float = APART) -> DataFrame:
    """``bars`` without the series that are ``mismatched``; codes that are not stored stay."""
    return bars.join(mismatched(bars, stored, apart).select("code").distinct(), "code", "left_anti")


def coverage(present: DataFrame, universe: DataFrame, dates: DataFrame, kinds: list[str], share: float = 0.5, least: int = 2) -> DataFrame:
    """``date, kind, n, need, fraction, ok`` for every date and kind (family or clock): how many codes of the universe are ``present`` (code, date, kind), and whether that is enough.

    What is present is counted by date and kind and only then meets the dates; the universe is a table of codes, joined by code.
    """
    codes = universe.select("code").where("code is not null").distinct()
    size = codes.count()
    need = max(least, math.ceil(size * share))
    n = present.select("code", "date", "kind").join(codes, "code", "left_semi").distinct().groupBy("date", "kind").agg(F.count("*").alias("n"))
    grid = dates.select("date").where("date is not null").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    rows = grid.join(n, ["date", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("date", "kind", "n", F.lit(need).alias("need"), (F.col("n") / max(size, 1)).alias("fraction"), (F.col("n") >= need).alias("ok"))


def gaps(covered: DataFrame, sample: int = 8) -> DataFrame:
    """``kind, n_days, date_from, date_to, sample`` of the dates that ``coverage`` finds too thin, the first ones as a sample."""
    thin = covered.where(~F.col("ok"))
    first = thin.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("date")))
    return first.groupBy("kind").agg(F.count("*").alias("n_days"), F.min("date").alias("date_from"), F.max("date").alias("date_to"), F.array_sort(F.collect_list(F.when(F.col("i") <= sample, F.col("date")))).alias("sample"))
