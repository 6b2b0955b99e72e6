"""Costs, exposures, risk measures and attribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import EPS, pearson, safe_div


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def slippage_bps(yearly_vol: Column, base: float = 2.0, factor: float = 10.0, low: float = 1.0, high: float = 30.0) -> Column:
    return clamp(base + yearly_vol * factor, low, high)


def impact_bps(amount: Column, day_amount: Column, coefficient: float = 0.1, cap: float = 50.0) -> Column:
    """Grows with the root of the share of the day's amount."""
    return F.least(F.lit(cap), coefficient * F.sqrt(F.coalesce(safe_div(amount, day_amount), F.lit(0.0))) * 100)


def fees(amount: Column, sell: Column, rate: float = 0.00025, least: float = 5.0, stamp: float = 0.0005) -> Column:
    """Commission of at least ``least``, and a stamp duty on sales, to two places."""
    return F.round(F.greatest(amount * rate, F.lit(least)) + F.when(sell, amount * stamp).otherwise(0.0), 2)


def lots(amount: Column, price: Column, lot: int = 100) -> Column:
    """Whole lots that an amount buys."""
    return F.coalesce(F.floor(safe_div(amount, price) / lot) * lot, F.lit(0)).cast("long")


def exposure(holdings: DataFrame, by: str, value: str = "value") -> DataFrame:
    """``by, value, weight_pct`` of holdings by group."""
    groups = holdings.groupBy(by).agg(F.sum(value).alias("value"))
    return groups.withColumn("weight_pct", F.coalesce(safe_div(F.col("value"), F.sum("value").over(Window.partitionBy())) * 100, F.lit(0.0)))


def tail_risk(rows: DataFrame, ret: str, alpha: float, *by: str) -> DataFrame:
    """``by, var, cvar``: the alpha quantile (linear) and the mean of what lies at or below it."""
    keys = list(by)
    limit = rows.groupBy(*keys).agg(F.percentile(ret, alpha).alias("var"))
    joined = rows.join(limit, keys) if keys else rows.join(F.broadcast(limit))
    tail = joined.where(F.col(ret) <= F.col("var")).groupBy(*keys, "var").agg(F.avg(ret).alias("cvar"))
    return tail.select(*keys, "var", "cvar")


def kupiec(rows: DataFrame, ret: str, limit: Column, alpha: float, *by: str) -> DataFrame:
    """``by, n, breaches, lr``: likelihood ratio of the share of returns below the limit against alpha."""
    counts = rows.groupBy(*by).agg(F.count(ret).alias("n"), F.count_if(F.col(ret) < limit).alias("breaches"))
    n, x = F.col("n"), F.col("breaches")
    p = clamp(x / n, 1e-12, 1 - 1e-12)
    lr = -2 * ((n - x) * math.log(1 - alpha) + x * math.log(alpha) - (n - x) * F.log(1 - p) - x * F.log(p))
    return counts.withColumn("lr", F.greatest(lr, F.lit(0.0)))


def scenarios(returns: DataFrame, ranges: DataFrame) -> DataFrame:
    """``scenario, days, total_pct, log_total, vol, worst_pct`` of returns (date, ret as a fraction) within each scenario's dates.

    Scenarios (name, first, last) are few: each return is put into the ones that hold its date.
    """
    inside = returns.join(F.broadcast(ranges), F.col("date").between(F.col("first"), F.col("last")))
    return inside.groupBy("scenario").agg(F.count("*").alias("days"), ((F.exp(F.sum(F.log1p("ret"))) - 1) * 100).alias("total_pct"), F.sum(F.log1p("ret")).alias("log_total"), F.stddev_pop("ret").alias("vol"), (F.min("ret") * 100).alias("worst_pct"))


def brinson(rows: DataFrame, sector: str, w: str, b: str, r: str, q: str) -> DataFrame:
    """``sector, allocation, selection, interaction`` from weights w (own) and b (benchmark) and returns r and q of sectors."""
    total = F.sum(F.col(b) * F.col(q)).over(Window.partitionBy())
    return rows.select(
        sector,
        ((F.col(w) - F.col(b)) * (F.col(q) - total)).alias("allocation"),
        (F.col(b) * (F.col(r) - F.col(q))).alias("selection"),
        ((F.col(w) - F.col(b)) * (F.col(r) - F.col(q))).alias("interaction"),
    )


def tracking(rows: DataFrame, own: str, other: str, *keys: str, yearly: int = 252) -> DataFrame:
    """``n, corr, tracking_error, ir, total_excess_pct`` of two aligned return series (fractions), by ``keys`` if any; deviations of the population."""
    x = F.col(own) - F.col(other)
    sd = F.stddev_pop(x)
    return rows.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col(own), F.col(other)).alias("corr"), (sd * math.sqrt(yearly)).alias("tracking_error"), F.when(sd > EPS, F.avg(x) / sd).alias("ir"), ((F.exp(F.sum(F.log1p(x))) - 1) * 100).alias("total_excess_pct"))


def turnover_by_date(weights: DataFrame) -> DataFrame:
    """``date, n, turnover, bought`` of weights (code, date, weight) from the second date on: codes held on it or on the date before, half the summed moves, and the summed rises.

    Each weight counts on its own date and, negative, on the next: two rows a weight, no self-join. Only the distinct dates are put in order.
    """
    dates = weights.select("date").distinct()
    after = dates.select("date", F.lead("date").over(Window.orderBy("date")).alias("next"), F.lag("date").over(Window.orderBy("date")).alias("before"))
    own = weights.join(after, "date")
    moves = own.where("before is not null").select("code", "date", "weight").unionByName(own.where("next is not null").select("code", F.col("next").alias("date"), (-F.col("weight")).alias("weight")))
    delta = moves.groupBy("date", "code").agg(F.sum("weight").alias("delta"))
    return delta.groupBy("date").agg(F.count("*").alias("n"), (F.sum(F.abs("delta")) / 2).alias("turnover"), F.sum(F.greatest("delta", F.lit(0.0))).alias("bought"))


def capped_weights(rows: DataFrame, score: str, cap: float, section: str = "date", rounds: int = 8) -> DataFrame:
    """``rows`` with ``weight``: shares of positive scores, each at most ``cap``; what is cut goes to the others in proportion, the rest is cash."""
    day = Window.partitionBy(section)
    positive = F.greatest(F.col(score), F.lit(0.0))
    rows = rows.withColumn("weight", F.coalesce(safe_div(positive, F.sum(positive).over(day)), F.lit(0.0)))
    # Each round is one more expression over the same partitioning: no shuffle is added.
    for _ in range(rounds):
        free = F.when(F.col("weight") < cap, F.col("weight")).otherwise(0.0)
        over = F.sum(F.greatest(F.col("weight") - cap, F.lit(0.0))).over(day)
        share = F.coalesce(safe_div(free, F.sum(free).over(day)), F.lit(0.0))
        rows = rows.withColumn("weight", F.least(F.lit(cap), F.col("weight") + over * share))
    return rows
