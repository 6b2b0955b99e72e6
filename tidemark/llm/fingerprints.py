"""Document fingerprints: a threshold-scaled sketch of word shingles.

A sketch keeps every 64-bit hash of a 5-word shingle that lies below a fixed fraction of the hash space, so
sketches of texts of any size can be merged and compared, and containment needs no common sketch size. So
that short texts are not left without hashes, a sketch also keeps its ``floor`` smallest ones; its limit says
below which value it is whole. Two sketches are compared below the smaller of their limits.

Null and empty texts have no shingles: their sketches are empty, equal to each other (likeness 1) and unlike
any other (likeness 0). Texts below five words have their whole sequence as one shingle. Equal texts have
equal fingerprints. Rows with equal ids stand in the order of their texts; rows with a null id come first.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat, slices
from tidemark.llm.texthash import shingles, words

SHINGLE = 5
#: One shingle hash in so many is kept, and at least so many of the smallest.
SCALE, FLOOR = 8, 32
WHOLE = 2**64 - 1
#: Bytes of text that a sorted run of documents should hold, and the most runs; beyond that they get longer.
RUN_BYTES, RUNS = 8 << 20, 10_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

Sketch = tuple[np.ndarray, int]


def sketch(hashes: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> Sketch:
    """The kept hashes, ascending and distinct, and the limit below which they are all there are."""
    limit = WHOLE // scale
    kept = np.unique(hashes[hashes <= np.uint64(limit)])
    if len(kept) < floor:
        kept = np.unique(hashes)
        if len(kept) <= floor:
            return kept, WHOLE
        kept = kept[:floor]
        limit = max(limit, int(kept[-1]))
    return kept, limit


def sketches(texts: list[bytes]) -> list[Sketch]:
    """The sketch of each text."""
    data, off = flat(pa.array(texts, pa.large_binary()))
    out = []
    for a, b in slices(off):
        h, at = shingles(*words(data[off[a] : off[b]], off[a : b + 1] - off[a]), SHINGLE)
        out += [sketch(h[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together, whole below the smaller limit."""
    limit = min(a[1], b[1])
    both = np.union1d(a[0], b[0])
    return both[both <= np.uint64(limit)], limit


def common(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """Sizes of both sketches and of what they share, below the smaller of their limits."""
    limit = np.uint64(min(a[1], b[1]))
    x, y = a[0][: np.searchsorted(a[0], limit, "right")], b[0][: np.searchsorted(b[0], limit, "right")]
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated intersection over union."""
    m, n, both = common(a, b)
    return both / (m + n - both) if m + n else float(len(a[0]) == len(b[0]))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has too."""
    m, n, both = common(a, b)
    return both / m if m else float(not len(a[0]))


def to_text(s: Sketch) -> str:
    """The limit and the hashes, as 16 hexadecimal digits each."""
    return np.concatenate([[np.uint64(s[1])], s[0]]).astype(">u8").tobytes().hex()


def from_text(text: str) -> Sketch:
    values = np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)
    return values[1:], int(values[0])


def edited(text: str, following: str) -> str:
    """``text`` with its last half (in code points, rounded down) replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_runs(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """Documents in runs of neighbouring ids, and the number of runs.

    Columns: run, guest, doc_id, text. Every run ends with guests, which are the first rows of the run after it
    (after the last: of the first run). The cuts between runs are quantiles of the ids; the driver gets an id for
    each run, and there are RUNS runs at most.
    """
    low = -(2**63)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(low)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(RUNS, max(1, -(-size // RUN_BYTES)))
    cuts = keyed.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else []
    # Doubles keep the order of longs, if not all differences: a run may then be a little longer.
    splits = [-math.inf, *sorted({float(c) for c in cuts or [] if c > low}), math.inf]

    def with_run(df: DataFrame) -> DataFrame:
        if len(splits) < 3:
            return df.withColumn("run", F.lit(0))
        bucket = Bucketizer(splits=splits, inputCol="d", outputCol="b")
        return bucket.transform(df.withColumn("d", F.col("k").cast("double"))).withColumn("run", F.col("b").cast("int")).drop("d", "b")

    firsts = with_run(keyed.select("k")).groupBy("run").agg(F.min("k").alias("k")).orderBy("run").collect()
    hosts = docs.sparkSession.createDataFrame([(r["k"], firsts[i - 1]["run"]) for i, r in enumerate(firsts)], "k long, host int")
    row = F.struct("run", F.lit(False).alias("guest"))
    places = F.when(F.col("host").isNull(), F.array(row)).otherwise(F.array(row, F.struct(F.col("host").alias("run"), F.lit(True).alias("guest"))))
    dealt = with_run(keyed).join(F.broadcast(hosts), "k", "left").select(F.explode(places).alias("p"), "k", "doc_id", "text")
    return dealt.select("p.run", "p.guest", "k", "doc_id", "text"), len(splits) - 1


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to that and to the next document.

    The text is shuffled once; a task streams its sorted runs and holds one Arrow batch and one further row.
    """
    dealt, runs = in_runs(docs, id_column, text_column)
    ordered = dealt.repartition(runs, "run").sortWithinPartitions("run", "guest", "k", "text").select("run", "guest", "doc_id", "text")

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for the one after it
        for batch in batches:
            pairs = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == row[0] and not held[1]:
                    pairs.append((held[2], held[3], row[3]))
                if not (held and held[0] == row[0] and held[1]):
                    held = row
            for part in _parts(pairs):
                yield _compared(part)

    return ordered.mapInArrow(fingerprint, SCHEMA)


def _parts(pairs: list[tuple], size: int = 1 << 20) -> Iterator[list[tuple]]:
    part, have = [], 0
    for pair in pairs:
        part.append(pair)
        have += len(pair[1])
        if have >= size:
            yield part
            part, have = [], 0
    if part:
        yield part


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    """Rows of SCHEMA for (doc_id, text, next text) in order of documents; a text that comes twice in a row is sketched once."""
    changed = [edited(text, after).encode() for _, text, after in pairs]
    texts = [pairs[0][1], *(after for _, _, after in pairs)]
    own = sketches([t.encode() for t in texts])
    new = sketches(changed)
    # Guests break the chain only at the end of a run, where the next pair begins with another text.
    here = [own[0]]
    for i, (_, text, _) in enumerate(pairs[1:], 1):
        here.append(own[i] if text == texts[i] else sketches([text.encode()])[0])
    columns = [
        pa.array([p[0] for p in pairs], pa.int64()),
        pa.array([len(p[1]) for p in pairs], pa.int64()),
        pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
        pa.array([to_text(s) for s in here]),
        pa.array([to_text(s) for s in new]),
        pa.array([likeness(a, b) for a, b in zip(here, new)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(here, own[1:])], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])
