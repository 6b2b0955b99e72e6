"""Feature tables on disk: partitioned Parquet, overwritten by partition, read back by pruned scans.

Writing replaces the partitions that the new rows touch and leaves the others, so repeating a write gives the same table. A
fingerprint column tells rows of one definition from those of another, and the day statistics carry the universe they are of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.xsec import day_cube


def write_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``rows`` touch; one sorted set of files for each."""
    rows.repartition(*by).sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def fingerprint(*parts: object) -> str:
    """Twelve digits that stand for a definition: names, windows, versions."""
    import hashlib

    return hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()[:12]


def write_features(rows: DataFrame, path: str, family: str, version: str) -> str:
    """Features (code, date, columns) of a family, partitioned by family and date; the fingerprint they are stored under."""
    mark = fingerprint(family, version, *sorted(c for c in rows.columns if c not in ("code", "date")))
    write_partitions(rows.withColumns({"family": F.lit(family), "fingerprint": F.lit(mark)}), path, "family", "date")
    return mark


def read_features(spark: SparkSession, path: str, family: str, mark: str, dates: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of one definition; dates prune partitions and columns prune the scan."""
    rows = spark.read.parquet(path).where((F.col("family") == family) & (F.col("fingerprint") == mark))
    if dates:
        rows = rows.where(F.col("date").isin(*[F.lit(d).cast("date") for d in dates]))
    return rows.select("code", "date", *columns) if columns else rows.drop("family", "fingerprint")


def write_cube(rows: DataFrame, features: list[str], path: str, universe: str, clock: str = "open") -> None:
    """Day statistics of the features, partitioned by universe, clock and date."""
    write_partitions(day_cube(rows, features).withColumns({"universe": F.lit(universe), "clock": F.lit(clock)}), path, "universe", "clock", "date")


def read_cube(spark: SparkSession, path: str, universe: str, clock: str = "open") -> DataFrame:
    return spark.read.parquet(path).where((F.col("universe") == universe) & (F.col("clock") == clock)).drop("universe", "clock")


def without_cube(rows: DataFrame, cube: DataFrame) -> DataFrame:
    """Rows of dates that have no statistics."""
    return rows.join(cube.select("date").distinct(), "date", "left_anti")


def tail(rows: DataFrame, stored: DataFrame, pad: int = 0) -> DataFrame:
    """Rows later than each code's last stored date, and ``pad`` days before, to be computed anew; all rows of new codes."""
    last = stored.groupBy("code").agg(F.max("date").alias("__last"))
    return rows.join(last, "code", "left").where(F.col("__last").isNull() | (F.col("date") > F.date_sub("__last", pad))).drop("__last")


def keep_longer(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, but the old rows of codes whose new rows are only the end of what is stored."""
    span = lambda df, x: df.groupBy("code").agg(F.min("date").alias(f"{x}_first"), F.max("date").alias(f"{x}_last"))
    shorter = span(old, "o").join(span(new, "n"), "code").where("n_first > o_first and n_last <= o_last").select("code")
    return new.join(shorter, "code", "left_anti").unionByName(old.join(shorter, "code", "left_semi"))


def series_hash(*columns: str) -> Column:
    """Aggregate: a hash of all values of a series, whatever the order of rows."""
    return F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *columns))), "\n").cast("binary"))


def without_dates(rows: DataFrame, dates: DataFrame, *by: str) -> DataFrame:
    """``rows`` without those of the ``dates`` (date, and ``by`` where the dates are of single groups)."""
    return rows.join(dates.select(*by, "date").distinct(), [*by, "date"], "left_anti")


def recent(rows: DataFrame, keep_days: int, *by: str) -> DataFrame:
    """``rows`` not older than ``keep_days`` days before the newest date of their group (of all, without groups)."""
    newest = rows.groupBy(*by).agg(F.max("date").alias("__newest"))
    joined = rows.join(newest, list(by)) if by else rows.join(F.broadcast(newest))  # one row
    return joined.where(F.datediff("__newest", "date") <= keep_days).select(*rows.columns)


def merged_rows(stored: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``new`` and those rows of ``stored`` whose keys it does not have; both have the same columns."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
