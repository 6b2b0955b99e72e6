"""Headlines: one row a title, decision days, labels as of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.scalars import title_hash


def unique(rows: DataFrame) -> DataFrame:
    """One row for each code and title (code, title, published_at, clock_quality, fetched_at): the first time it was published, an exact clock before a bare date."""
    rows = rows.withColumn("title_hash", title_hash(F.col("title")))
    order = Window.partitionBy("code", "title_hash").orderBy(F.when(F.col("clock_quality") == "timestamp", 0).otherwise(1), F.asc_nulls_last("published_at"), "fetched_at", "title")
    return rows.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def decision_days(rows: DataFrame, calendar: DataFrame, fill: str = "09:35") -> DataFrame:
    """``rows`` with ``decision_date``: the first session whose fill clock is at or after publication; a bare date waits for the session after it.

    ``calendar`` has the trading ``date``s. A row fetched after that session's fill goes to the first session after the fetch.
    """
    sessions = calendar.select(F.lit(0).alias("_k"), F.col("date").alias("decision_date"), F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.lit(fill)), "yyyy-MM-dd HH:mm").alias("_fill"))
    known = F.when(F.col("clock_quality") == "date_only", F.date_trunc("day", "published_at") + F.expr("interval 1 day")).otherwise(F.col("published_at"))
    ready = rows.withColumn("_ready", F.greatest(known, F.coalesce("fetched_at", known))).withColumn("_k", F.lit(0))
    # Headlines are dealt by day, and each day looks up its own few sessions: no task holds all rows.
    days = ready.select(F.to_date("_ready").alias("_day"), "_k").distinct()
    spread = sessions.withColumn("_day", F.to_date("_fill"))
    ahead = asof.forward(days.withColumn("_next", F.date_add("_day", 1)), spread.select("_k", F.col("_day").alias("_s"), F.col("decision_date").alias("_after")), "_k", "_next", "_s").drop("_k", "_s", "_next")
    own = spread.select("_day", F.col("decision_date").alias("_today"), "_fill")
    joined = ready.withColumn("_day", F.to_date("_ready")).join(ahead, "_day", "left").join(own, "_day", "left")
    day = F.when(F.col("_fill") >= F.col("_ready"), F.col("_today")).otherwise(F.col("_after"))
    return joined.withColumn("decision_date", day).select(*rows.columns, "decision_date")


def as_of(rows: DataFrame, day: str, limit: int) -> DataFrame:
    """The newest ``limit`` titles of each code published (or else fetched) up to a day."""
    at = F.coalesce(F.to_date("published_at"), F.to_date("fetched_at"))
    newest = Window.partitionBy("code").orderBy(F.desc("published_at"), "title")
    return rows.where(at <= F.lit(day).cast("date")).withColumn("__place", F.row_number().over(newest)).where(F.col("__place") <= limit).drop("__place")
