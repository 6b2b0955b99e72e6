"""Exact top-k inner products by columnar branch and bound.

Vectors are whole numbers, floor(SCALE * x) for each component x. Candidates are packed into blocks stored dimension by dimension
(one row a dimension), queries into blocks stored vector by vector; every candidate block meets every block of the
stated query set, each pair in a task of its own. There a query's scores grow over groups of dimensions, those where it has the
most mass first. After each group the score so far plus or minus the mass that is left (the product of the norms of
what remains of both vectors) bounds the score; candidates whose upper bound is below the k-th best lower bound are dropped and the
rest compacted. Each pair of blocks yields k rows a query at most; their ranks are cut per task before they are shuffled.

Rows whose vector is null, or holds a null or non-finite component, take no part; neither do rows without an id, nor
(against a query of n dimensions) candidates of other than n. Empty vectors score 0 with each other. Equal scores
go to the smaller id; of rows that share an id each is a candidate of its own, and none is one for its own id; of queries
that share an id the smallest vector is asked. Fewer candidates
than k give fewer rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

SCALE = 256
#: Vectors of a candidate block and of a query block, and dimensions of a group.
CANDIDATES, QUERIES, GROUP = 2048, 256, 16


def whole(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``id, n, v``: the rows that take part, with whole-numbered vectors."""
    x = F.transform(F.col(vector_column), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("id", F.size("x").alias("n"), F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def blocks(rows: DataFrame, size: int, columnar: bool) -> DataFrame:
    """``n, ids, values``: blocks of at most ``size`` vectors of n dimensions as bytes of 64-bit numbers, within each task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(n: int) -> pa.RecordBatch:
            ids, values = held.pop(n)
            matrix = np.array(values, np.int64).reshape(len(ids), n)
            matrix = np.ascontiguousarray(matrix.T if columnar else matrix)
            return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "vals": pa.array([matrix.tobytes()], pa.binary())})

        for batch in batches:
            for i, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids, values = held.setdefault(n, ([], []))
                ids.append(i)
                values.append(v)
                if len(ids) == size:
                    yield block(n)
        for n in list(held):
            yield block(n)

    return rows.mapInArrow(pack, "n int, ids binary, vals binary")


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, group: int = GROUP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, the ids and the scores of its k best candidates (more on ties); ``c`` is dimensions by candidates.

    Sums are whole numbers throughout; the bounds are doubles, widened by a part in 1e9 and by one.
    """
    dims = len(c)
    order = np.argsort(-np.square(c.astype(float)).sum(axis=1)) if dims else np.zeros(0, int)
    c, q = c[order], q[:, order]
    starts = list(range(0, dims, group))
    # Norms of what is left from each group on.
    left_c = np.array([np.sqrt(np.square(c[s:].astype(float)).sum(axis=0)) for s in [*starts[1:], dims]])
    left_q = np.array([np.sqrt(np.square(q[:, s:].astype(float)).sum(axis=1)) for s in [*starts[1:], dims]])
    own = {i: np.flatnonzero(c_ids == i) for i in np.intersect1d(q_ids, c_ids).tolist()}
    everyone = np.arange(len(c_ids))
    for j, query in enumerate(q_ids.tolist()):
        alive = np.delete(everyone, own[query]) if query in own else everyone
        score = np.zeros(len(alive), np.int64)
        for g, s in enumerate(starts):
            part = c[s : s + group, alive] if len(alive) < len(everyone) else c[s : s + group]
            score = score + q[j, s : s + group] @ part
            if len(alive) <= k or g == len(starts) - 1:
                continue
            mass = left_c[g, alive] * left_q[g, j] * (1 + 1e-9) + 1
            floor = np.partition(score - mass, len(alive) - k)[len(alive) - k]
            keep = score + mass >= floor
            alive, score = alive[keep], score[keep]
        if len(alive) > k:
            least = np.partition(score, len(alive) - k)[len(alive) - k]
            keep = score >= least
            alive, score = alive[keep], score[keep]
            first = np.lexsort((c_ids[alive], -score))[:k]
            alive, score = alive[first], score[first]
        yield query, c_ids[alive], score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each row of ``queries`` with the other rows of ``vectors``."""
    candidates = written(blocks(whole(vectors, id_column, vector_column, scale), CANDIDATES, True).withColumn("c", F.monotonically_increasing_id()), "candidates")
    one_each = whole(queries, id_column, vector_column, scale).groupBy("id").agg(F.min(F.struct("n", "v")).alias("x")).select("id", "x.n", "x.v")
    asked = written(blocks(one_each.repartition(max(1, -(-queries.count() // QUERIES))), QUERIES, False), "queries")
    # A row for each candidate block and query block of one dimension; only numbers of blocks go to the driver.
    numbers = candidates.select("c", "n")
    pairs = asked.select("n", F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals")).join(numbers, "n")
    met = candidates.drop("n").join(pairs.repartition("c"), "c")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, q_ids, q, c_ids, c in zip(*(x.to_pylist() for x in batch.columns)):
                q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                found = list(best(np.frombuffer(q, np.int64).reshape(len(q_ids), n), q_ids, np.frombuffer(c, np.int64).reshape(n, len(c_ids)), c_ids, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"])

    found = met.select("n", "q_ids", "q_vals", "ids", "vals").mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
