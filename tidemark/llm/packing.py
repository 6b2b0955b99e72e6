"""Best-fit packing by exact-complement hashing.

Documents are tokenized and cut into pieces of at most CAPACITY tokens. The number of pieces of each length (CAPACITY
counts, whatever the corpus) is all that the plan needs. From the longest length down, the gap beside a length is looked up
among single lengths, sums of pairs and sums of triples; a combination that fills it exactly is used as often as
its scarcest length allows. What is left goes, longest first, into the fullest sequence that takes it. A plan is a list of
patterns with counts; pieces take their places in it by their rank among pieces of their length, and ranks are
given within hashed buckets of each length, so that a length of any share of the pieces is spread over tasks.

Null texts are empty; an empty text is the one id 0. Texts of any length are cut whole. Repeated rows are packed each for
itself, a null doc_id is kept, ties of rank fall by doc_id and piece. An empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import flat, slices, written

CAPACITY = 2048
#: Pieces of a length are ranked in so many buckets at least, and in one for each BUCKET_ROWS pieces of the corpus.
BUCKETS, BUCKET_ROWS = 64, 1_000_000
#: New words after which a worker forgets those not used since the last time, and bytes of text that are encoded together.
REMEMBERED, TOGETHER = 250_000, 2 << 20

#: Texts of these characters need no normalization but lower case, and their words are found by WORD (Latin letters and signs).
PLAIN = re.compile("[\t-\r -~¡-©«-±´¶-¸»¿-į]*")
WORD = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-į]+|[0-9]|[^\\sa-zß-öø-į0-9]+")
#: What a tokenizer file must say for that to hold (fixed values): its normalizers, the pattern of its words, and their ending.
NORMALIZERS, PATTERN, ENDING = ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"


def by_words(path: str) -> bool:
    """Whether the tokenizer of a file lower-cases and splits as PLAIN and WORD suppose."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
    first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    blanks = [n.get("content") for n in normalizers if n["type"] == "Replace"]
    split = (first.get("type"), (first.get("pattern") or {}).get("Regex"), first.get("behavior"), first.get("invert"))
    return [n["type"] for n in normalizers] == NORMALIZERS and blanks == [" "] and split == ("Split", PATTERN, "Removed", True) and spec["model"].get("end_of_word_suffix") == ENDING


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers. Files that are not ``by_words`` go to the library text by text.

    The tokenizer drops white space and encodes each word for itself, so the words of a plain text are looked up and only new
    ones are encoded; other texts go to the library whole. Words not used for a while are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = PLAIN if by_words(path) else re.compile("(?!)")
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode new words together: parted by blanks they stay words."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        cuts = (np.searchsorted(np.array(found.word_ids), np.arange(len(words) + 1)) * 4).tolist()
        self.recent.update(zip(words, [ids[a:b] for a, b in zip(cuts, cuts[1:])]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words that several of them share are looked for once."""
        split = [None if "<|" in t or not self.plain.fullmatch(t) else WORD.findall(t.lower()) for t in texts]
        if len(self.recent) > REMEMBERED:
            self.recent, self.older = {}, self.recent
        new = list(set().union(*(w for w in split if w)).difference(self.recent))
        known = self.older
        self.recent.update((w, known[w]) for w in new if w in known)
        new = [w for w in new if w not in known]
        for i in range(0, len(new), 5000):
            self.learn(new[i : i + 5000])
        return [self.library(t) if w is None else b"".join(map(self.recent.__getitem__, w)) for t, w in zip(texts, split)]


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` [, ``ids``] for every piece of ``doc_id, text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]

        def encoded(texts: pa.Array) -> Iterator[bytes]:
            for a, b in slices(flat(texts)[1], TOGETHER):
                yield from encoder.encode_all([t or "" for t in texts.slice(a, b - a).to_pylist()])

        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                ids += b"\0\0\0\0"
                for n, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row = (doc, n, a // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int64).tolist()) if with_ids else row)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema)

    schema = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _complement(free: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``, the longest first. ``free[n]`` counts pieces of length n."""
    if free[gap] > 0:
        return (gap,)

    def pair(total: int, top: int) -> tuple[int, ...] | None:
        high = np.arange(min(total - 1, top), (total + 1) // 2 - 1, -1)
        ok = np.flatnonzero((free[high] > 0) & (free[total - high] > (high * 2 == total)))
        return (int(high[ok[0]]), total - int(high[ok[0]])) if len(ok) else None

    if found := pair(gap, gap):
        return found
    for c in np.flatnonzero(free[1:gap])[::-1] + 1:
        c = int(c)
        if 3 * c < gap:
            break
        free[c] -= 1
        rest = pair(gap - c, c) if gap - c > 1 else None
        free[c] += 1
        if rest:
            return (c, *rest)
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; ``counts[n]`` is the number of pieces of length n."""
    free = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    for longest in range(capacity, 0, -1):
        while free[longest] > 0:
            free[longest] -= 1
            rest = () if longest == capacity else _complement(free, capacity - longest)
            free[longest] += 1
            if rest is None:
                break
            pattern = (longest, *rest)
            need = {n: pattern.count(n) for n in pattern}
            times = min(int(free[n]) // k for n, k in need.items())
            for n, k in need.items():
                free[n] -= k * times
            out.append((pattern, times))
    # Open sequences by their gap: patterns with counts.
    gaps: dict[int, list[list]] = {}
    for n in range(capacity, 0, -1):
        left = int(free[n])
        while left:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                fit = capacity // n
                times, pattern = (left // fit, (n,) * fit) if left >= fit else (1, (n,) * left)
                used = times * len(pattern)
            else:
                group = gaps[gap][-1]
                times = min(left, group[1])
                pattern, used = (*group[0], n), times
                group[1] -= times
                if not group[1]:
                    gaps[gap].pop()
                    if not gaps[gap]:
                        del gaps[gap]
            left -= used
            gaps.setdefault(capacity - sum(pattern), []).append([pattern, times])
    return out + [(tuple(p), t) for groups in gaps.values() for p, t in groups]


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``cut`` (see ``pieces``) with ``sequence_id`` and ``offset``."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    # For every place of every pattern: the length, the first rank that goes there, its first sequence, the offset.
    places, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for n in pattern:
            places.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    table = np.array(sorted(places), np.int64).reshape(-1, 4)
    bound = cut.sparkSession.sparkContext.broadcast(table)

    buckets = max(BUCKETS, int(counts.sum()) // BUCKET_ROWS)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = keyed.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = cut.columns
    rest = [c for c in names if c != "length"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bound.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.select(*rest, "length", F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` tokens."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return packed(written(pieces(docs, path, capacity), "pieces"), capacity)
