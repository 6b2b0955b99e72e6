"""Bars: price and volume series by entity and date, or by entity and five-minute slot.

Events are trades here (entity = user, price = value, one unit each) and so are shipped order lines (entity = supplier,
price = extended price, volume = quantity). Values that are NULL, NaN or infinite are dropped before a bar is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import finite


#: Rows of a table that one task is to have.
ROWS_A_PIECE = 1_000_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pieces(table: DataFrame) -> int:
    """In how many partitions a stored table is to be dealt, so that what one task holds does not grow with it (Parquet counts by its footers)."""
    return max(table.sparkSession.sparkContext.defaultParallelism, table.count() // ROWS_A_PIECE + 1)


def _bars(trades: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One bar for each key of ``trades`` (price, size, and an order within the key).

    The trades themselves are dealt by entity (a bar holds few of them, and a bar's state is wider than a trade): bars come out dealt by entity and sorted by ``keys``, as windows along series want them.
    """
    o = order
    return trades.where("price is not null").repartition(keys[0]).groupBy(*keys).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("size").alias("volume")
    )


def trades_of_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("code"), "ts", F.to_date("ts").alias("date"), finite(F.col("value")).alias("price"), F.lit(1.0).alias("size"), "event_id")


def daily_bars(events: DataFrame) -> DataFrame:
    """``code, date, open, high, low, close, volume`` by user and day."""
    return _bars(trades_of_events(events), ["code", "date"], F.struct("ts", "event_id"))


def slot_bars(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Bars by user and slot of ``minutes``; ``slot`` is the slot's start."""
    slot = F.window("ts", f"{minutes} minutes")["start"].alias("slot")
    return _bars(trades_of_events(events).withColumn("slot", slot), ["code", "date", "slot"], F.struct("ts", "event_id"))


def ship_bars(lineitem: DataFrame) -> DataFrame:
    """Bars by supplier and shipping day."""
    trades = lineitem.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), finite(F.col("l_extendedprice")).alias("price"), F.col("l_quantity").alias("size"), "l_orderkey", "l_linenumber", "l_partkey")
    return _bars(trades, ["code", "date"], F.struct("l_orderkey", "l_linenumber", "l_partkey", "price"))


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of each entity."""
    newest = Window.partitionBy("code").orderBy(F.desc("date"))
    return bars.withColumn("__place", F.row_number().over(newest)).where(F.col("__place") <= n).drop("__place")


def of_codes(bars: DataFrame, codes: DataFrame) -> DataFrame:
    """Bars of the entities in ``codes``; a semi-join whose smaller side Spark picks by size."""
    return bars.join(codes.select("code").distinct(), "code", "left_semi")


def span(bars: DataFrame) -> DataFrame:
    """One row for each entity: first and last date, number of bars."""
    return bars.groupBy("code").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_bars"))


def complete(bars: DataFrame) -> Column:
    """Whether a bar has all prices and a volume (which may be 0)."""
    ok = F.lit(True)
    for c in ("open", "high", "low", "close", "volume"):
        ok = ok & F.col(c).isNotNull()
    return ok
