"""Exact duplicates by a persistent index of digests.

The index is a table of the digests of all texts seen so far, in buckets by digest and sorted within them. A batch of new
rows is reduced to its distinct digests (partial aggregation, so that a text of any number of copies is one row a task), which meet
the index in a sort-merge anti-join: the index is read bucket by bucket and never shuffled. What is new is appended, so a text stays under the
row that brought it first; within a batch that is the row with the largest doc_id. Adding a batch again, after a failure say, appends
nothing that is there, and under the same name gives the same answer.

Texts are equal when their bytes are; nothing is normalized. A null text is empty. A null doc_id stands below all others. Of rows
equal in both doc_id and text one stays, the first as they were read. An empty table gives an empty result. Further columns, of any name, are
ignored. Only built-in functions are used.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import spread_join, work_folder, written

#: Distinct digests that a bucket of a new index is meant for.
BUCKET_ROWS = 1_000_000
#: Batches in which one table is taken in, the largest doc_ids first.
BATCHES = 2


class DigestIndex:
    """The index kept in the folder ``path``, made with ``buckets`` buckets if there is none.

    With as many buckets as a shuffle has partitions, or more, the index is joined as it lies; fewer are shuffled.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        spec = f"{path}/spec"
        try:
            self.buckets = spark.read.schema("buckets int").parquet(spec).first().buckets
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).cast("int").alias("buckets")).coalesce(1).write.parquet(spec)
        self.table = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.table} (digest binary, keep_id long, batch string, place long) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{path}/digests'"
        )

    def rows(self) -> DataFrame:
        """``digest, keep_id, batch, place``: each digest once, with the row that brought it."""
        return self.spark.table(self.table)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The distinct digests of ``batch`` that are not in the index, with the row of each that stays."""
        # Smaller places win among equal ids; a null id is the smallest in an array of structs.
        first = F.max(F.struct("doc_id", (-F.col("place")).alias("back"), "batch"))
        distinct = batch.groupBy("digest").agg(first.alias("__keep")).select("digest", F.col("__keep.doc_id").alias("keep_id"), F.col("__keep.batch").alias("batch"), (-F.col("__keep.back")).alias("place"))
        return distinct.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, batch: DataFrame) -> None:
        """Append what is new in ``batch``, a written table of ``digested`` rows."""
        self.fresh(batch).select("digest", "keep_id", "batch", "place").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def resolved(self, rows: DataFrame) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, text_sha256`` of digested rows whose batches were added; groups are counted among these rows."""
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        index = self.rows().select("digest", "keep_id", F.col("batch").alias("__batch"), F.col("place").alias("__place"))
        known = written(sizes.join(index.hint("merge"), "digest").withColumn("n", F.col("group_size")), "groups")
        kept = (F.col("batch") == F.col("__batch")) & (F.col("place") == F.col("__place"))
        return spread_join(rows, known, "digest", "n").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def digested(docs: DataFrame, batch: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, digest, batch, place`` of every row, as a written table; ``place`` tells equal rows apart."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")), 256))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), digest.alias("digest"))
    return written(rows.withColumn("batch", F.lit(batch)).withColumn("place", F.monotonically_increasing_id()), "digests")


def deduplicated(docs: DataFrame, path: str | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per document with the largest doc_id of its text, through a new index at ``path``.

    The rows are digested once, then taken in by falling ranges of doc_id: whatever a later batch brings has a smaller id than what the index holds.
    """
    spark = docs.sparkSession
    rows = digested(docs, "all")
    seen = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    index = DigestIndex(spark, path or f"{work_folder(spark)}/index-{uuid.uuid4().hex}", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen.n // BUCKET_ROWS)))
    low, high = seen.low or 0, seen.high or 0
    edges = sorted({low + (high - low) * i // batches for i in range(1, batches)}, reverse=True)
    for top, bottom in zip([None, *edges], [*edges, None]):
        batch = rows if bottom is None else rows.where(F.col("doc_id") > bottom)
        index.add(batch if top is None else batch.where(F.col("doc_id").isNull() | (F.col("doc_id") <= top)))
    return index.resolved(rows)
