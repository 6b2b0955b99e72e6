"""Partitioned tables whose readers see a whole version or none.

A write puts its partitions in a folder of its own (``data/write=...``) and then adds a version: one small Parquet file that
lists the live partitions and the writes they are in. That file comes into being by one rename, so a failure at any point before leaves the old version, and
what the failed write left behind belongs to no version. Upkeep (merging, dropping, pruning) makes a version too; files go in ``vacuum`` only.

One writer at a time: of two that begin with the same version the second is refused. Partition columns are kept as text; a NULL in one is
refused. A version that lists nothing is an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """The table in the folder ``path``, of the columns ``schema`` (DDL, partition columns among them as strings), partitioned by ``by``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: tuple[str, ...]):
        self.spark, self.path, self.by = spark, path, by
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names
        if wrong := [c for c in by if dict(self.empty().dtypes).get(c) != "string"]:
            raise ValueError(f"partition columns must be strings of the schema: {wrong}")

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    # Versions.

    def _listed(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/versions")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def current(self) -> int:
        """The newest version; 0 before the first write."""
        listed = self._listed()
        return 0 if listed is None else int(listed.agg(F.max("version")).first()[0] or 0)

    def live(self, version: int | None = None) -> DataFrame:
        """``write`` and the partition columns of every partition of a version (default: the newest)."""
        version = self.current() if version is None else version
        listed = self._listed()
        if listed is None:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in ("write", *self.by)))
        return listed.where((F.col("version") == version) & F.col("write").isNotNull()).select("write", *self.by)

    def _commit(self, live: DataFrame, before: int) -> int:
        # A row without a write keeps a version that lists nothing; one file, so that the version is there whole or not at all.
        mark = self.spark.createDataFrame([(None,) * (1 + len(self.by))], live.schema)
        live.unionByName(mark).repartition(1).write.mode("errorifexists").parquet(f"{self.path}/versions/version={before + 1}")
        return before + 1

    # Reading.

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; the scan is pruned to the partitions that it lists."""
        return self._of(self.live(version))

    def _of(self, live: DataFrame) -> DataFrame:
        """The rows of the writes and partitions in ``live``."""
        writes = [r[0] for r in live.select("write").distinct().collect()]  # one for each write that still counts
        if not writes:
            return self.empty()
        return self._rows(*writes).join(live, ["write", *self.by], "left_semi").select(*self.columns)

    # Upkeep; each returns the version it made, or the newest if there was nothing to do.

    def _put(self, rows: DataFrame) -> DataFrame:
        """Store ``rows`` as a write that no version lists yet; what ``live`` says of it."""
        write = uuid.uuid4().hex
        checked = rows.select(*self.columns)
        for c in self.by:
            checked = checked.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"{c} is NULL in a row")).cast("string")))
        checked.repartition(*self.by).write.partitionBy(*self.by).parquet(f"{self.path}/data/write={write}")
        return self._rows(write).select("write", *self.by).distinct()

    def _rows(self, *writes: str) -> DataFrame:
        """Everything in ``writes``, with ``write``."""
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields) + ", `write` string"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/data").where(F.col("write").isin(*writes))

    def replace(self, rows: DataFrame) -> int:
        """The partitions that ``rows`` touch become these rows; the others stay."""
        before = self.current()
        made = self._put(rows)
        if not made.limit(1).count():
            return before
        old = self.live(before).join(made.select(*self.by), list(self.by), "left_anti")
        return self._commit(old.unionByName(made), before)

    def merge(self, rows: DataFrame, *keys: str, stored_first: bool = False) -> int:
        """Rows join those of their partitions; of rows of one key (NULLs are equal) the new one stays, or the stored one with ``stored_first``.

        ``rows`` are made once, and stored. What gives way to the other side's keys is left out of one more write; the side that comes first
        keeps its files, so a partition may have files in several writes.
        """
        before = self.current()
        new = self._put(rows)
        if not new.limit(1).count():
            return before
        live = self.live(before)
        touched = new.select(*self.by)
        kept, old = live.join(touched, list(self.by), "left_anti"), live.join(touched, list(self.by), "left_semi")
        stored, added = self._of(old), self._of(new)
        first, second = (stored, added) if stored_first else (added, stored)
        same = F.lit(True)
        taken = first.select(*(F.col(k).alias(f"__{k}") for k in keys))
        for k in keys:
            same = same & second[k].eqNullSafe(taken[f"__{k}"])
        rest = self._put(second.join(taken, same, "left_anti"))
        return self._commit(kept.unionByName(old if stored_first else new).unionByName(rest), before)

    def drop(self, partitions: DataFrame) -> int:
        """Leave out the partitions named in ``partitions``, by any of the partition columns it has."""
        before = self.current()
        names = [c for c in self.by if c in partitions.columns]
        if not names:
            raise ValueError("no partition column is given")
        live = self.live(before)
        left = live.join(partitions.select(*names).distinct(), names, "left_anti")
        return self._commit(left, before) if left.count() < live.count() else before

    def prune(self, column: str, keep: list[str]) -> int:
        """Leave out all partitions whose ``column`` is not in ``keep``; an empty ``keep`` is not known and prunes nothing."""
        keep = [k for k in keep if k]
        if not keep:
            return self.current()
        gone = self.live().where(~F.col(column).isin(keep)).select(column)
        return self.drop(gone)

    def clear(self) -> int:
        """A version without rows."""
        before = self.current()
        return self._commit(self.live(before).limit(0), before) if before else 0

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete writes that none of the newest versions lists (left behind by failures too), and say how many; no write may be under way."""
        newest = self.current()
        listed = self._listed()
        wanted = set() if listed is None else {r[0] for r in listed.where((F.col("version") > newest - keep_versions) & F.col("write").isNotNull()).select("write").distinct().collect()}
        jvm = self.spark._jvm
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        files = data.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(data):
            return 0
        gone = [s.getPath() for s in files.listStatus(data) if s.getPath().getName().startswith("write=") and s.getPath().getName().removeprefix("write=") not in wanted]
        for path in gone:
            files.delete(path, True)
        return len(gone)
