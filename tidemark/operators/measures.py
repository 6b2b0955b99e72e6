"""Measures of trades, curves and panels: trade statistics by score, drawdowns, tails, day differences of curves, fill rates, halted bars.

All are grouped aggregates or windows of one entity. Rows with a NULL value do not count; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel, finite, refuse

P = Panel()
#: Buckets of entry scores, from and below; words of a name that say an entity does not trade.
SCORE_BUCKETS = (("<55", 0, 55), ("55-64", 55, 65), ("65-74", 65, 75), ("75+", 75, 101))
HALT_WORDS = "停牌|暂停上市|halt|suspended"


def trade_metrics(trades: DataFrame, *by: str, order: tuple[str, ...] = ("date", "code"), hold: int = 1) -> DataFrame:
    """``by, n, win_pct, mean_pct, total_pct, drawdown_pct, sharpe`` of trades (ret_pct) taken one after the other in ``order``.

    The equity begins at 1 and compounds; the drawdown is the deepest fall from its peak. Sharpe is mean over sample deviation, by
    the root of how many holding periods a year has; NULL where returns do not vary.
    """
    ret = finite(F.col("ret_pct").cast("double"))
    known = trades.withColumn("__r", ret).where("__r is not null")
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # A loss of all or more ends the product; its logarithm stands for 0 then.
    growth = F.greatest(1 + F.col("__r") / 100, F.lit(1e-300))
    rows = known.select(*by, *(c for c in order if c not in by), "__r", F.exp(F.sum(F.log(growth)).over(so_far)).alias("__e"))
    peak = F.greatest(F.lit(1.0), F.max("__e").over(so_far))
    rows = rows.withColumn("__d", (peak - F.col("__e")) / peak * 100)
    sd = F.stddev_samp("__r")
    sharpe = F.when(sd > 1e-9, F.avg("__r") / F.nullif(sd, F.lit(0.0)) * math.sqrt(252 / max(1, hold)))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("__r") > 0).cast("double")) * 100).alias("win_pct"), F.avg("__r").alias("mean_pct"), ((F.exp(F.sum(F.log(F.greatest(1 + F.col("__r") / 100, F.lit(1e-300))))) - 1) * 100).alias("total_pct"),
        F.greatest(F.lit(0.0), F.max("__d")).alias("drawdown_pct"), sharpe.alias("sharpe"),
    )


def score_bucket(score: Column) -> Column:
    """The bucket of an entry score; NULL outside 0 to 101."""
    name = F.lit(None).cast("string")
    for label, low, high in SCORE_BUCKETS:
        name = F.when((score >= low) & (score < high), label).otherwise(name)
    return name


def by_score(trades: DataFrame, score: str = "score", order: tuple[str, ...] = ("date", "code")) -> DataFrame:
    """``bucket, n, win_pct, mean_pct, total_pct`` of trades by the bucket of their score."""
    rows = trades.withColumn("bucket", score_bucket(F.col(score))).where("bucket is not null")
    return trade_metrics(rows, "bucket", order=order).select("bucket", "n", "win_pct", "mean_pct", "total_pct")


def against_holding(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """``code, hold_pct, trades_pct, excess_pct``: what an entity's trades made in all against holding it from its first close to its last."""
    held = bars.where("close > 0").groupBy("code").agg(F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b"), F.count("*").alias("n"))
    held = held.where("n >= 2").select("code", ((F.col("b") / F.col("a") - 1) * 100).alias("hold_pct"))
    made = trade_metrics(trades, "code", order=("date",)).select("code", F.col("total_pct").alias("trades_pct"))
    return held.join(made, "code", "left").withColumn("excess_pct", F.col("trades_pct") - F.col("hold_pct"))


def drawdown_and_calmar(equity: DataFrame, *by: str, value: str = "equity", order: str = "date", yearly: float = 252.0) -> DataFrame:
    """``by, n, drawdown_pct, calmar``: the deepest fall from a peak, and the yearly growth in per cent over it; NULL with fewer than two points, calmar also without a fall."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = equity.where(F.col(value).isNotNull()).select(*by, order, F.col(value).alias("__e"), F.max(value).over(so_far).alias("__p"))
    fall = F.when(F.col("__p") > 0, (F.col("__p") - F.col("__e")) / F.nullif("__p", F.lit(0.0)) * 100).otherwise(F.lit(0.0))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(fall).alias("deepest"), F.min_by("__e", order).alias("a"), F.max_by("__e", order).alias("b"))
    deepest = F.when(F.col("n") >= 2, F.round(F.greatest("deepest", F.lit(0.0)), 4))
    growth = F.col("b") / F.nullif("a", F.lit(0.0))
    cagr = F.when(growth > 0, F.pow(growth, yearly / F.greatest(F.col("n") - 1, F.lit(1))) - 1)
    return g.withColumn("drawdown_pct", deepest).select(*by, "n", "drawdown_pct", F.when(F.col("drawdown_pct") > 1e-9, cagr * 100 / F.nullif("drawdown_pct", F.lit(0.0))).alias("calmar"))


def tails(rows: DataFrame, ret: str, alpha: float, *by: str) -> DataFrame:
    """``by, normal_var, tail_ratio``: mean plus the normal quantile of deviations (of the population), and the mean of the upper tail over that of the lower, sizes only."""
    x = finite(F.col(ret).cast("double"))
    known = rows.select(*by, x.alias("__x")).where("__x is not null")
    cut = known.groupBy(*by).agg(F.percentile("__x", alpha).alias("__low"), F.percentile("__x", 1 - alpha).alias("__high"), (F.avg("__x") + NormalDist().inv_cdf(alpha) * F.stddev_pop("__x")).alias("normal_var"))
    both = known.join(cut, list(by)) if by else known.join(F.broadcast(cut))  # one row
    ends = both.groupBy(*by, "normal_var").agg(F.avg(F.when(F.col("__x") <= F.col("__low"), F.col("__x"))).alias("l"), F.avg(F.when(F.col("__x") >= F.col("__high"), F.col("__x"))).alias("h"))
    ratio = F.when(F.col("l") != 0, F.abs("h") / F.abs(F.nullif("l", F.lit(0.0)))).when(F.col("h") != 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return ends.select(*by, "normal_var", ratio.alias("tail_ratio"))


def curve_differences(own: DataFrame, other: DataFrame, *by: str) -> DataFrame:
    """``by, date, side, own_pct, other_pct, gap_pp`` of two curves (date, equity): days in both, or in one only.

    Returns are from one common day to the next; the first common day has none.
    """
    keys = [*by, "date"]
    both = own.select(*keys, F.col("equity").alias("__a")).join(other.select(*keys, F.col("equity").alias("__b")), keys, "full")
    side = F.when(F.col("__b").isNull(), "own").when(F.col("__a").isNull(), "other").otherwise("both")
    rows = both.withColumn("side", side)
    common = Window.partitionBy(*by, "side").orderBy("date")
    step = lambda c: F.when((F.col("side") == "both") & (F.lag(c).over(common) > 0), (F.col(c) / F.lag(c).over(common) - 1) * 100)
    return rows.withColumns({"own_pct": step("__a"), "other_pct": step("__b")}).select(*keys, "side", "own_pct", "other_pct", (F.col("own_pct") - F.col("other_pct")).alias("gap_pp"))


def volume_anomaly(bars: DataFrame, threshold: float = 2.0) -> DataFrame:
    """``code, date, ratio, kind, strength``: volume over its mean of 20 rows; from the 20th row on, where that is not 0."""
    w = P.series.rowsBetween(-19, 0)
    b = bars.select("code", "date", "volume", F.row_number().over(P.series).alias("n"), F.avg("volume").over(w).alias("usual")).where("n >= 20 and usual <> 0")
    r = F.col("volume") / F.col("usual")
    kinds = [(r >= threshold * 2, "extreme_high", 3), (r >= threshold, "high", 2), (r >= 1.5, "slightly_high", 1), (r < 0.3, "extreme_low", -2), (r < 0.5, "low", -1)]
    kind, strength = F.lit("normal"), F.lit(0)
    for holds, name, value in reversed(kinds):
        kind, strength = F.when(holds, name).otherwise(kind), F.when(holds, value).otherwise(strength)
    return b.select("code", "date", F.round(r, 2).alias("ratio"), kind.alias("kind"), strength.alias("strength"))


def strength(ratio: np.ndarray, threshold: float = 2.0) -> np.ndarray:
    """The strengths of ``volume_anomaly`` of ratios."""
    return np.select([ratio >= threshold * 2, ratio >= threshold, ratio >= 1.5, ratio < 0.3, ratio < 0.5], [3.0, 2.0, 1.0, -2.0, -1.0], 0.0)


def without_halted(bars: DataFrame, texts: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Bars without a volume of 0 or less whose ``texts`` (names of columns) have no word of a halt, as it is written; and ``code, kept, no_volume, halted`` of all.

    A NULL volume is no sign of a halt, nor is a NULL text. A bar that is idle and halted counts as idle.
    """
    idle = F.coalesce(F.col("volume") <= 0, F.lit(False))
    halted = F.concat_ws(" ", *texts).rlike(HALT_WORDS) if texts else F.lit(False)
    audit = bars.groupBy("code").agg(F.count_if(~idle & ~halted).alias("kept"), F.count_if(idle).alias("no_volume"), F.count_if(halted & ~idle).alias("halted"))
    return bars.where(~idle & ~halted), audit


def fill_rates(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """``by, name, n, filled, rate``: how many values of each column there are; empty texts do not count."""
    there = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(there(c)).alias(f"__{i}") for i, c in enumerate(columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"__{i}").alias("filled")) for i, c in enumerate(columns)))
    return g.select(*by, "n", F.inline(cells)).select(*by, "name", "n", "filled", F.when(F.col("n") > 0, F.round(F.col("filled") / F.nullif("n", F.lit(0)), 4)).alias("rate"))


def limit_flags(bars: DataFrame, limit_pct: Column) -> DataFrame:
    """``code, date, change_pct, limit_up, limit_down`` of closes against the close before; an entity's first row has no change and is at no limit."""
    before = F.lag("close").over(P.series)
    change = F.when((before > 0) & (F.col("close") > 0), (F.col("close") / before - 1) * 100)
    rows = bars.withColumns({"change_pct": change, "__limit": limit_pct})
    hit = lambda x: F.coalesce(x, F.lit(False))
    return rows.select("code", "date", "change_pct", hit(F.col("change_pct") >= F.col("__limit")).alias("limit_up"), hit(F.col("change_pct") <= -F.col("__limit")).alias("limit_down"))


def capped_parity(rows: DataFrame, vol: str, sector: str, cap: float, sector_cap: float, section: str = "date") -> DataFrame:
    """``rows`` with ``weight``: shares in proportion to 1 / volatility, each at most ``cap``; a sector that holds more than ``sector_cap`` is scaled down to it, and what is cut stays cash."""
    refuse(rows, "weight")
    day = Window.partitionBy(section)
    inverse = F.when(F.col(vol) > 0, 1 / F.nullif(vol, F.lit(0.0))).otherwise(F.lit(0.0))
    w = rows.withColumn("__i", inverse).withColumn("__w", F.least(F.lit(cap), F.col("__i") / F.nullif(F.sum("__i").over(day), F.lit(0.0))))
    held = F.sum("__w").over(Window.partitionBy(section, sector))
    return w.withColumn("weight", F.coalesce(F.when(held > sector_cap, F.col("__w") * sector_cap / held).otherwise(F.col("__w")), F.lit(0.0))).drop("__i", "__w")
