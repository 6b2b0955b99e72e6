"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct 5-word shingles (the whole sequence where there are fewer words; nothing
without words). Its sketch holds REGISTERS registers: the minimum over the set of an exponential variable per
register, put on an exponentially spaced scale and truncated. Sketches merge by the larger register, and two
sketches agree in a register about as often as the sets overlap.

1. One pass over the texts gives each document's set size, a 128-bit signature of the set, and its registers.
   Documents with equal sets form a class, which goes on as one node (its smallest doc_id).
2. BANDS bands of ROWS registers are the keys of buckets. In every bucket the smallest node is paired with each
   other one. Pairs whose sizes cannot reach the threshold go; so do those whose joint estimate by maximum likelihood
   lies MARGIN below it. The rest are confirmed on the full sets, which are made again from the texts
   of only those documents.
   The EARLY bands go first: what they link needs no pair from the other bands.
3. Components of the confirmed links label the nodes. Buckets that still hold several components are compared
   in blocks: within a task all nodes of two blocks, by their estimate and then on their full sets; only links leave it.
   So a group of any size costs one pair a member once its members are linked, and no bucket is capped.

A pair at the very threshold shares no band with probability (1 - 0.75 ** ROWS) ** BANDS, about 2e-6; links above it
are missed less often still.

Null texts are empty: no shingles, no links, kept. Rows with a null doc_id are not linked: their component is null and
they are not kept. Equal rows are copies of each other. Rows that share a doc_id share its component. Ties fall to the
smallest doc_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import flat, slices, spread_join, written
from tidemark.llm.components import components
from tidemark.llm.texthash import mix, shingles, words

SHINGLE = 5
ROWS, BANDS, EARLY = 5, 48, 4
REGISTERS = ROWS * BANDS
#: The scale of the registers: base of the spacing, rate, and the largest value.
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: A pair is confirmed on the full sets if its estimate is no more than this below the threshold (over 4 standard deviations).
MARGIN = 0.13
#: Bytes of sets and registers in a block when a bucket of several components is compared.
BLOCK = 4 << 20

_rng = np.random.default_rng(77)
_LOW = _rng.integers(1, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_HIGH = _rng.integers(1, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_FACTORS = _rng.integers(1, 2**62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _rng.integers(1, 2**62, BANDS, dtype=np.uint64)


def registers(sets: np.ndarray) -> np.ndarray:
    """The registers of one set of 64-bit hashes (at least one)."""
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(sets), 1024):
        h = np.multiply.outer(_LOW, low[i : i + 1024])
        h += np.multiply.outer(_HIGH, high[i : i + 1024])
        np.minimum(least, h.min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    # Larger registers stand for smaller minima.
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + TOP // 4, 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    total = (reg.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return mix(total ^ _BAND_SEEDS).view(np.int64)


def _log_likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, m: int) -> np.ndarray:
    """Of similarity ``j``, for sets of which the first has the share ``u`` of both sizes together."""

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    tiny = 1e-12
    a, b = np.maximum(p(u - (1 - u) * j), tiny), np.maximum(p((1 - u) - u * j), tiny)
    return more * np.log(a) + less * np.log(b) + (m - more - less) * np.log(np.maximum(1 - a - b, tiny))


_GRID = np.linspace(0, 1, 201)


def estimate(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Similarity of largest joint likelihood, given set sizes and how many registers of a exceed (``more``) or fall short (``less``)."""
    u = (n_a / (n_a + n_b))[:, None]
    j = _GRID[None, :] * np.minimum(u / (1 - u), (1 - u) / u)
    score = _log_likelihood(j, u, more[:, None], less[:, None], m)
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The distinct shingle hashes of each text, a slice of the batch at a time."""
    data, off = flat(column)
    for a, b in slices(off):
        h, at = shingles(*words(data[off[a] : off[b]], off[a : b + 1] - off[a]), SHINGLE)
        yield [np.unique(h[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, sig_a, sig_b, reg`` of ``doc_id, text``: 128 bits that stand for the set, and the registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y, reg = [], [], [], []
            for sets in _sets(batch.column(1)):
                for s in sets:
                    n.append(len(s))
                    x.append(mix(s).sum(dtype=np.uint64).view(np.int64) if len(s) else 0)
                    y.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64) if len(s) else 0)
                    reg.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(reg, pa.binary())], ["doc_id", "n_shingles", "sig_a", "sig_b", "reg"])

    return docs.mapInArrow(sketch, "doc_id long, n_shingles long, sig_a long, sig_b long, reg binary")


def _banded(nodes: DataFrame) -> DataFrame:
    """``key, node, early, weight``: a row for each band of each node; ``early`` marks the first EARLY bands, ``weight`` is the bytes of the node's set and registers."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch.column(1).to_pylist()]
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            early = np.tile(np.arange(BANDS) < EARLY, len(batch))
            weight = np.repeat(batch.column(2).to_numpy() * 8 + REGISTERS * 2, BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(node, pa.int64()), pa.array(early), pa.array(weight, pa.int64())], ["key", "node", "early", "weight"])

    return nodes.select("node", "reg", "n_shingles").mapInArrow(bands, "key long, node long, early boolean, weight long")


def _likely(n_a, n_b, reg_a, reg_b, threshold: float) -> np.ndarray:
    """Which pairs of sizes and register rows (two equally long matrices) may reach the threshold."""
    more, less = (reg_a > reg_b).sum(axis=1), (reg_a < reg_b).sum(axis=1)
    out = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    # Agreement alone already rules out most pairs.
    out &= REGISTERS - more - less >= REGISTERS * (threshold - 2 * MARGIN)
    at = np.flatnonzero(out)
    if len(at):
        # The likelihood has one peak: the estimate lies above a value if it still rises there.
        u, level = n_a[at] / (n_a[at] + n_b[at]), threshold - MARGIN
        rises = [_log_likelihood(level + d, u, more[at], less[at], REGISTERS) for d in (0, 0.002)]
        out[at] = rises[1] >= rises[0]
    return out


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that may link by size and joint estimate."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("reg").alias(f"reg_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                a, b, n_a, n_b, reg_a, reg_b = batch.slice(i, 2048).columns
                ok = _likely(n_a.to_numpy(), n_b.to_numpy(), _matrix(reg_a.to_pylist()), _matrix(reg_b.to_pylist()), percent / 100)
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "n_a", "n_b", "reg_a", "reg_b").mapInArrow(keep, "a long, b long")


def _full_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, shingles`` (64-bit hashes, ascending) of the ``node`` ids, made again from their texts."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for part in _sets(batch.column(1)) for s in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    # A hashed join at any size: the ids are no table to broadcast.
    wanted = nodes.select(F.col("node").alias("doc_id")).distinct().hint("shuffle_hash")
    return written(docs.where("doc_id is not null").join(wanted, "doc_id", "left_semi").mapInArrow(full, "node long, shingles binary"), "sets")


def _linked(x: bytes, y: bytes, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    pairs = written(pairs, "pairs")
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(link, "a long, b long").distinct()


def _across(members: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of different components that share a bucket. ``members``: key, node, component, and the size of the bucket's sets and registers in bytes.

    A bucket is dealt into blocks of about BLOCK bytes, and every two of its blocks meet in one task. There a pair is looked at in the
    first band it shares only, by its estimate and then on the full sets, and only links leave the task.
    """
    members = written(members, "members")
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), count).cast("int")
    dealt = members.withColumn("count", count).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "component")
    dealt = dealt.join(nodes.select("node", "n_shingles", "reg"), "node").join(_full_sets(members.select("node"), docs), "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        one, two = group[group.block == group.one], group[group.block == group.two]
        within = bool(group.one.iloc[0] == group.two.iloc[0])
        reg_one, reg_two = _matrix(list(one.reg)), _matrix(list(two.reg))
        keys_one, keys_two = np.array([band_keys(r) for r in reg_one]), np.array([band_keys(r) for r in reg_two])
        n_two, c_two, id_two, s_two = two.n_shingles.to_numpy(), two.component.to_numpy(), two.node.to_numpy(), list(two.shingles)
        a, b = [], []
        for node, n, c, s, reg, keys, key in zip(one.node, one.n_shingles, one.component, one.shingles, reg_one, keys_one, one.key):
            same = keys_two == keys
            later = id_two > node if within else id_two != node
            at = np.flatnonzero((c_two != c) & later & (same.argmax(axis=1) == int((keys == key).argmax())))
            if len(at):
                at = at[_likely(np.full(len(at), n), n_two[at], np.broadcast_to(reg, (len(at), REGISTERS)), reg_two[at], percent / 100)]
            for i in at.tolist():
                if _linked(s, s_two[i], percent):
                    a.append(node)
                    b.append(id_two[i])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.groupBy("key", "one", "two").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: documents linked where 100 * intersection >= percent * union."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    seen = written(sketched(docs), "sketches")
    some = seen.where("doc_id is not null and n_shingles > 0")
    classes = some.groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("reg").alias("reg"))
    nodes = written(classes, "classes")
    rows = _banded(nodes)
    least = rows.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("size"), F.sum("weight").alias("bytes")).where("size > 1")
    least = written(least.withColumn("n", F.col("size")), "centers")
    shared = written(spread_join(rows, least, "key", "n", "inner"), "buckets")
    pair = [F.col("center").alias("a"), F.col("node").alias("b")]
    first = shared.where("early and node <> center").select(*pair).distinct()
    links = written(_confirmed(_estimated(first, nodes, percent), docs, percent), "links")
    labels = written(components(links), "labels")
    # What the first bands joined needs no pair from the others.
    center = labels.select(F.col("node").alias("center"), F.col("component").alias("to"))
    apart = shared.where("node <> center").join(labels, "node", "left").join(center, "center", "left").where(F.coalesce("component", "node") != F.coalesce("to", "center"))
    then = written(apart.select(*pair).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    links = written(links.unionByName(_confirmed(_estimated(then, nodes, percent), docs, percent)), "links")
    # A node's other classes, where one doc_id has several texts, need no link: they share the id.
    labels = written(components(links), "labels")
    labelled = shared.where("size > 2").select("key", "node", F.col("bytes").alias("size")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    members = labelled.join(mixed, "key", "left_semi")
    more = written(_across(members, nodes, docs, percent), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    members = some.select("doc_id", "sig_a", "sig_b", "n_shingles").join(nodes.drop("reg"), ["sig_a", "sig_b", "n_shingles"]).select("doc_id", "node").distinct()
    of = members.join(labels, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    out = seen.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text, and any others), one of each group: that of its smallest doc_id.

    Of rows that share a doc_id one stays, that of the smallest text (null first); of rows without an id one of each text.
    """
    found = near_duplicates(docs, percent=percent)
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct().hint("shuffle_hash")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    known = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    if not again.limit(1).count() and not docs.where("doc_id is null").limit(1).count():
        return known.select(*docs.columns)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    repeated = known.join(again, "doc_id", "left_semi").withColumn("__place", place).where("__place = 1")
    # Copies without an id are told apart by a hash of their text, and one row of each is kept by partial aggregation.
    unnamed = docs.where("doc_id is null").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("__hash"), F.col("text").isNull().alias("__null")).agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return known.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns)).unionByName(unnamed)
