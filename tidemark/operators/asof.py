"""As-of joins: the last row at or before a time, or the first at or after it, without a range join.

Both sides are put in one ordered series for each key and carried along it by a window, so cost follows the rows and not the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, key: str, at: str, since: str, strict: bool = False, tie: str | None = None, pieces: int | None = None) -> DataFrame:
    """``left`` with the columns of the last row of ``right`` whose ``since`` is at or before ``at`` (before, if ``strict``).

    Of rows at one time the one with the largest ``tie`` is taken. Rows without a match get NULLs. Series are dealt over ``pieces`` partitions (default: the session's).
    """
    return _carried(left, right, key, at, since, strict, tie, forward=False, pieces=pieces)


def forward(left: DataFrame, right: DataFrame, key: str, at: str, since: str, tie: str | None = None) -> DataFrame:
    """``left`` with the columns of the first row of ``right`` whose ``since`` is at or after ``at``."""
    return _carried(left, right, key, at, since, False, tie, forward=True)


def _carried(left: DataFrame, right: DataFrame, key: str, at: str, since: str, strict: bool, tie: str | None, forward: bool, pieces: int | None = None) -> DataFrame:
    kept = [c for c in right.columns if c != key]
    rows = left.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*kept)).schema[0].dataType).alias("_r"), F.lit(None).cast(right.schema[tie or since].dataType).alias("_tie"))
    found = right.where(F.col(since).isNotNull()).select(F.col(key), F.col(since).alias("_at"), F.lit(0).alias("_left"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*kept).alias("_r"), F.col(tie or since).alias("_tie"))
    both = rows.unionByName(found)
    if pieces:
        both = both.repartition(pieces, key)
    # At one time matches stand before the rows that look for them; after them, if they must be earlier.
    side: Column = F.col("_left").desc() if strict else F.col("_left").asc()
    if forward:
        order = Window.partitionBy(key).orderBy(F.col("_at").desc(), side, F.col("_tie").asc_nulls_first())
    else:
        order = Window.partitionBy(key).orderBy(F.col("_at").asc(), side, F.col("_tie").asc_nulls_first())
    carried = both.withColumn("_r", F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_left = 1")
    names = [c for c in kept if c not in left.columns]
    return carried.select("_l.*", *(F.col(f"_r.{c}").alias(c) for c in names))
