"""One-to-one matching of two logs by time: the closest pairs first, and what matched labels say about the first log.

Both logs of an entity stand in one ordered series; every row looks at the nearest row of the other log before and after it. Two rows that choose each other
are a pair, and the rest goes on without them, until no pair is left within the tolerance. A round is one sort by entity and makes all mutual pairs of all entities, so the
number of rounds is at most that of the pairs in the longest chain of rows whose distances only fall. Ties go to the earlier row.

Logs have the columns ``by``, ``ts`` (a timestamp; one without a zone is of the session's) and ``id`` (unique within the log). Rows whose time or entity is NULL are matched with nothing. Repeated times are matched in the order of
ids, the last of the first log with the first of the second before others. Empty logs give no pairs.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: seconds within which a label belongs to an entry of another time.
TOLERANCE = 300


def _mutual(rows: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """``by, left, right, seconds`` of rows (``side`` 0 or 1) that are each other's nearest."""
    order = Window.partitionBy(*by).orderBy("ts", "side", "id")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    seen = lambda side: F.when(F.col("side") == side, F.struct("ts", "id"))
    near = {f"{name}{side}": f(seen(side), ignorenulls=True).over(w) for side in (0, 1) for name, f, w in (("before", F.last, before), ("after", F.first, after))}
    rows = rows.withColumns(near)
    other = lambda name: F.when(F.col("side") == 0, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    rows = rows.withColumns({"b": other("before"), "a": other("after")})
    gap = lambda x: F.abs(F.col(f"{x}.ts").cast("double") - F.col("ts").cast("double"))
    rows = rows.withColumns({"gb": gap("b"), "ga": gap("a")})
    back = F.col("gb").isNotNull() & (F.col("ga").isNull() | (F.col("gb") <= F.col("ga")))
    rows = rows.select(*by, "side", "id", F.when(back, F.col("b.id")).otherwise(F.col("a.id")).alias("pick"), F.when(back, F.col("gb")).otherwise(F.col("ga")).alias("seconds")).where(F.col("seconds") <= tolerance)
    one = rows.where("side = 0").select(*by, F.col("id").alias("left"), F.col("pick").alias("right"), "seconds")
    two = rows.where("side = 1").select(*by, F.col("pick").alias("left"), F.col("id").alias("right"))
    return one.join(two, [*by, "left", "right"])


def _checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; a folder of one's own is set only where that is unset and all runs on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(folder)


def matched(first: DataFrame, second: DataFrame, by: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``by, left, right, seconds``: ids of both logs and how far apart they are; no id is in two pairs. Each round is cut off by a checkpoint."""
    _checkpoints(first.sparkSession)
    side = lambda df, n: df.select(*by, F.col("ts").cast("timestamp").alias("ts"), "id", F.lit(n).alias("side")).dropna(subset=[*by, "ts"])
    left = side(first, 0).unionByName(side(second, 1)).checkpoint()
    pairs = None
    while True:
        found = _mutual(left, by, tolerance).checkpoint()
        pairs = found if pairs is None else pairs.unionByName(found)
        if not found.limit(1).count():
            return pairs
        ids = found.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("id")), F.struct(F.lit(1).alias("side"), F.col("right").alias("id")))).alias("x")).select(*by, "x.side", "x.id")
        left = left.join(ids, [*by, "side", "id"], "left_anti").checkpoint()


def effectiveness(entries: DataFrame, *by: str) -> DataFrame:
    """``by, total, labelled, hits, misses, uncertain, hit_rate, miss_rate, label_rate`` of entries with ``outcome`` (``true_positive``, ``false_positive``, ``uncertain``, else unlabelled)."""
    n = lambda value: F.count_if(F.col("outcome") == value)
    g = entries.groupBy(*by).agg(F.count("*").alias("total"), n("true_positive").alias("hits"), n("false_positive").alias("misses"), n("uncertain").alias("uncertain"))
    labelled = F.col("hits") + F.col("misses")
    rate = lambda x, of: F.round(x / F.nullif(of, F.lit(0)), 4)
    return g.select(*by, "total", labelled.alias("labelled"), "hits", "misses", "uncertain", rate(F.col("hits"), labelled).alias("hit_rate"), rate(F.col("misses"), labelled).alias("miss_rate"), rate(labelled, F.col("total")).alias("label_rate"))


def labelled(entries: DataFrame, labels: DataFrame, by: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``entries`` (``by``, ts, id and others) with ``outcome`` and ``seconds`` of the label (``by``, ts, id, outcome) matched to each; NULL without one."""
    pairs = matched(entries, labels, by, tolerance)
    found = pairs.join(labels.select(*by, F.col("id").alias("right"), "outcome"), [*by, "right"]).select(*by, F.col("left").alias("id"), "outcome", "seconds")
    return entries.join(found, [*by, "id"], "left")
