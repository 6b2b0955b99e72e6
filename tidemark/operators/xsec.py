"""Cross-sections: day statistics (the cube), standard scores, neutral scores, breadth, peers, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import EPS, finite, pearson


def long_form(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``keys, name, x``: one row for each finite feature value."""
    cells = F.array(*(F.struct(F.lit(f).alias("name"), finite(F.col(f).cast("double")).alias("x")) for f in features))
    return rows.select(*keys, F.inline(cells)).where("x is not null")


def day_cube(rows: DataFrame, features: list[str], section: str = "date", least: int = 2) -> DataFrame:
    """``section, name, n, mu, sigma`` of each feature over the section's names; sigma is NULL where the variance is 1e-12 or less."""
    cube = long_form(rows, [section], features).groupBy(section, "name").agg(F.count("x").alias("n"), F.avg("x").alias("mu"), F.var_pop("x").alias("v"))
    return cube.where(F.col("n") >= least).select(section, "name", "n", "mu", F.when(F.col("v") > EPS, F.sqrt("v")).alias("sigma"))


def cube_scores(rows: DataFrame, cube: DataFrame, features: list[str], section: str = "date", code: str = "code") -> DataFrame:
    """``section, code, name, z`` by stored statistics; rows of dates without a cube are dropped, flat features are 0."""
    cells = long_form(rows, [section, code], features).join(cube.select(section, "name", "mu", "sigma"), [section, "name"])
    return cells.select(section, code, "name", F.coalesce((F.col("x") - F.col("mu")) / F.col("sigma"), F.lit(0.0)).alias("z"))


def size_bucket(size: Column, buckets: int, section: str = "date", code: str = "code") -> Column:
    """Equal-count buckets by size, 0 the smallest: int(rank * buckets / n), rank from 0."""
    day = Window.partitionBy(section)
    rank = F.row_number().over(day.orderBy(size.asc_nulls_first(), code)) - 1
    return F.floor(rank * buckets / F.count(F.lit(1)).over(day)).cast("int")


def neutralised(score: Column, *groups: str) -> Column:
    """The score less its group's mean, about 50."""
    return score - F.avg(score).over(Window.partitionBy(*groups)) + 50


def score_of_z(z: Column) -> Column:
    """50 + 10 z within 10 and 95."""
    return F.greatest(F.lit(10.0), F.least(F.lit(95.0), 50 + 10 * z))


def breadth(gap: Column, trigger: float, *groups: str) -> Column:
    """Share of the group's gaps at or above the trigger."""
    return F.avg((gap >= trigger).cast("double")).over(Window.partitionBy(*groups))


def less_peers(rows: DataFrame, value: str, sector: str, section: str = "date", least: int = 3) -> DataFrame:
    """``rows`` with ``peer``, the median of the sector (of all, if it has fewer than ``least``), and the difference to it."""
    of_sector = rows.groupBy(section, sector).agg(F.percentile(value, 0.5).alias("__of_sector"), F.count(value).alias("__n"))
    of_all = rows.groupBy(section).agg(F.percentile(value, 0.5).alias("__of_all"))
    joined = rows.join(of_sector, [section, sector]).join(of_all, section)
    joined = joined.withColumn("peer", F.when(F.col("__n") >= least, F.col("__of_sector")).otherwise(F.col("__of_all")))
    return joined.withColumn("less_peer", F.col(value) - F.col("peer")).drop("__of_sector", "__of_all", "__n")


def pair_correlations(rows: DataFrame, features: list[str], least: int) -> DataFrame:
    """``a, b, n, r, reason`` for each pair of features over the rows that have both: NULL when sparse or flat."""
    x = {f: finite(F.col(f).cast("double")) for f in features}
    stats = []
    for a, b in combinations(features, 2):
        has = x[a].isNotNull() & x[b].isNotNull()
        u, v = F.when(has, x[a]), F.when(has, x[b])
        stats.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(u).alias("n"), pearson(u, v).alias("r"), F.least(F.stddev_pop(u), F.stddev_pop(v)).alias("s")))
    found = rows.agg(F.array(*stats).alias("p")).select(F.inline("p"))
    reason = F.when(F.col("n") < least, "sparse").when(F.col("s") <= EPS, "constant").otherwise("ok")
    return found.select("a", "b", "n", F.when(reason == "ok", F.col("r")).alias("r"), reason.alias("reason"))


def day_rank(score: str, section: str = "date", code: str = "code") -> Column:
    """Place by score, the best first, ties by code."""
    return F.row_number().over(Window.partitionBy(section).orderBy(F.desc_nulls_last(score), code))
