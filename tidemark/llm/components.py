"""Connected components of a link table, by alternating star contractions.

Links are never gathered: each round is two aggregations and joins on the vertex, so a vertex of any degree is
handled by partial aggregation and by the split of skewed joins. Rounds end when no link changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links to the smallest neighbour: of larger ends (large star), or of smaller ends and oneself (small star).

    ``links`` has ``u > v``; both ends see a link in the large star, only the larger in the small one.
    """
    seen = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = seen.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of a link; ``component`` is the smallest node that can be reached.

    ``links`` has two long columns, the ends in any order; repeats and loops do no harm, rows with a null are no links.
    """
    a, b = links.columns[:2]
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        step = _star(links, large=True).where("u <> v").distinct()
        links = written(_star(step, large=False).where("u <> v").distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
