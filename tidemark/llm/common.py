"""What the operators share: the shared work folder, tables that cut lineage, flat views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step takes at a time; bounds the memory of a task whatever the batch holds.
STEP_BYTES = 2 << 20


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps and lost executors read it again instead of recomputing it."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that more than this part of all rows share are broadcast; there are fewer of them than this.
HOT = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, a written table distinct in ``key`` whose ``count`` says how many of the rows have it (rows have no null key).

    What is in ``table`` for keys of more than a HOT-th of the rows, fewer than HOT of them, is broadcast; rows of such keys are dealt
    out evenly in the shuffle that joins the others. ``count`` is left out.
    """
    others = [c for c in table.columns if c not in (key, count)]
    most = (table.agg(F.sum(count)).first()[0] or 0) / HOT
    hot = F.broadcast(table.where(F.col(count) > most).select(key, F.struct(*others).alias("__hot")))
    marked = rows.join(hot, key, "left").withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1))
    rare = table.where(F.col(count) <= most).select(key, F.lit(0).cast("long").alias("__salt"), F.struct(*others).alias("__rare"))
    found = F.coalesce("__hot", "__rare")
    joined = marked.join(rare, [key, "__salt"], "left").withColumn("__found", found)
    if how == "inner":
        joined = joined.where("__found is not null")
    return joined.select(*rows.columns, *(F.col(f"__found.{c}").alias(c) for c in others))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``step`` bytes; a longer text comes alone."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + step, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
