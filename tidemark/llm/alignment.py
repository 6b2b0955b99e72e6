"""Alignment of two tokenizers over the bytes of a text.

Both tokenizers cut the bytes of a blank and the text. A string of labels has one letter a byte: ``.`` where no token ends, ``a`` or ``b`` where
one of the first or the second tokenizer ends, ``x`` where both do. A regular expression reads off the spans up to each ``x``, and the labels counted within
a span say how many tokens of each side form a group. The last tokens of a group end together: they are a link.

Both tokenizers part a text before a blank that follows no white space: the pattern of the first ends a token there, and no piece of the
second goes across (checked on loading). So the units between such places are aligned one by one, and each different unit of a
worker's texts once, until it forgets those not used for a while. Units of any length are aligned whole.

How often two ids are linked in the corpus is counted from the links of all texts. A link's tokens end alike, so one is a suffix of the
other: the vocabularies bound the number of different links (``Vocabularies.bound``), and their counts are small enough to hand to every task.

Null and empty texts have no tokens, nor have texts that a tokenizer does not give back byte by byte. Repeated rows are aligned (and counted) each
for itself; a null doc_id stays null; an empty table gives an empty result; further columns are ignored. Ties for the highest count are all highest.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat, slices, written
from tidemark.llm.token_counts import WHITE, byte_alphabet

#: Units after which a worker forgets those not used since the last time, and the longest that it remembers.
REMEMBERED, LONGEST = 100_000, 64
#: New units whose tokens are found together.
TOGETHER = 20_000

_white = re.escape(WHITE)
_other = re.escape(WHITE.replace(" ", ""))
#: From a blank to the next blank that follows no white space.
UNIT = re.compile(f" [{_white}]*[^{_white}]*(?:[{_other}][{_white}]*[^{_white}]*)*")
#: A piece that may go across the border of two units.
ACROSS = re.compile(f"[^{_white}] ")
GROUP = re.compile(b"[^x]*x")
LABELS = np.frombuffer(b".abx", np.uint8)


class Vocabularies:
    """A byte-level BPE file (``tokenizers``) and a ``sentencepiece`` model, with the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path_a} is no plain byte-level tokenizer")
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        to_byte = byte_alphabet()
        entries = {i: s for s, i in spec["model"]["vocab"].items()}
        self.bytes_a = [bytes(to_byte[c] for c in entries[i]) if i in entries else b"" for i in range(max(entries) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i))]
        self.bytes_b = [b""] * len(pieces)
        for i in plain:
            self.bytes_b[i] = bytes([int(pieces[i][3:5], 16)]) if self.b.is_byte(i) else pieces[i].replace("▁", " ").encode()
            if not self.b.is_byte(i) and ACROSS.search(pieces[i].replace("▁", " ")):
                raise ValueError(f"{path_b}: the piece {pieces[i]!r} goes across units")
        self.n_b = len(pieces)
        # A blank at the end of a text is a unit by itself; the second tokenizer gives nothing for the empty text that follows its own blank.
        self.blank = [i for i in [self.b.piece_to_id("▁")] if self.bytes_b[i] == b" "]
        if len(self.bytes_a) * self.n_b >= 1 << 32:
            raise ValueError("the vocabularies are too large for the numbers of links")
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])

    def bound(self) -> int:
        """No more different links can occur: of two tokens that end together one is a suffix of the other."""
        return int(self.length_a.sum() + self.length_b.sum())


class Aligner:
    """Alignments of units: groups as text, links as little-endian unsigned 32-bit numbers (first id * size of the second vocabulary + second id), numbers of tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.words = Vocabularies(path_a, path_b)
        self.recent: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        # Ids with what follows them: "," or, at the end of a side, "|" and ";".
        self.shown = [f"{i}{sign}" for n, signs in ((len(self.words.bytes_a), ",|"), (self.words.n_b, ",;")) for sign in signs for i in range(n)]

    def learn(self, units: list[str]) -> None:
        """Align new units (each begins with a blank, the first tokenizer parts them after all but white space)."""
        v = self.words
        units = sorted(units, key=lambda u: u[-1] in WHITE)
        raw = [u.encode() for u in units]
        ids_b = [ids or v.blank for ids in v.b.encode([u[1:] for u in units], num_threads=1)]
        whole = [b"".join(map(v.bytes_b.__getitem__, ids)) == r for ids, r in zip(ids_b, raw)]
        self.recent.update((u, None) for u, ok in zip(units, whole) if not ok)
        units, raw, ids_b = ([x for x, ok in zip(xs, whole) if ok] for xs in (units, raw, ids_b))
        if not units:
            return
        data = b"".join(raw)
        # What ends in white space would join that of the next unit: such units (ends of texts) go to the first tokenizer one by one.
        open_end = sum(u[-1] in WHITE for u in units)
        apart = ["".join(units[: len(units) - open_end]), *units[len(units) - open_end :]]
        a = np.array([i for part in apart for i in v.a.encode(part, add_special_tokens=False).ids], np.int64)
        b = np.array([i for ids in ids_b for i in ids], np.int64)
        end_a, end_b = np.cumsum(v.length_a[a]), np.cumsum(v.length_b[b])
        ends = np.cumsum([len(r) for r in raw])
        if b"".join(map(v.bytes_a.__getitem__, a.tolist())) != data:
            raise ValueError("the first tokenizer does not give its text back")
        label = np.zeros(len(data), np.uint8)
        label[end_a - 1] |= 1
        label[end_b - 1] |= 2
        if (label[ends - 1] != 3).any():
            raise ValueError("a token goes across units")
        spans = GROUP.findall(LABELS[label].tobytes())
        kinds = {s: i for i, s in enumerate(set(spans))}
        size = np.array([(s.count(b"a") + 1, s.count(b"b") + 1) for s in kinds])[[kinds[s] for s in spans]]
        upto_a, upto_b = np.cumsum(size[:, 0]), np.cumsum(size[:, 1])
        links = (a[upto_a - 1] * v.n_b + b[upto_b - 1]).astype("<u4")
        # Each group's tokens of the first side, then those of the second.
        shown = np.empty(len(a) + len(b), np.int64)
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[upto_a - 1] = len(v.bytes_a)
        sign_b[upto_b - 1] = v.n_b
        group = np.arange(len(spans))
        shown[np.arange(len(a)) + (upto_b - size[:, 1])[np.repeat(group, size[:, 0])]] = a + sign_a
        shown[np.arange(len(b)) + upto_a[np.repeat(group, size[:, 1])]] = b + sign_b + 2 * len(v.bytes_a)
        text = [self.shown[i] for i in shown.tolist()]
        groups = np.searchsorted(np.cumsum([len(s) for s in spans]), ends) + 1
        last_a, last_b = upto_a[groups - 1], upto_b[groups - 1]
        at, at_a, at_b, at_g = 0, 0, 0, 0
        packed = links.tobytes()
        for unit, to_a, to_b, to_g in zip(units, last_a.tolist(), last_b.tolist(), groups.tolist()):
            to = to_a + to_b
            self.recent[unit] = ("".join(text[at:to]), packed[4 * at_g : 4 * to_g], to_a - at_a, to_b - at_b)
            at, at_a, at_b, at_g = to, to_a, to_b, to_g

    def align(self, texts: list[str | None]) -> list[tuple[str, bytes, int, int]]:
        """Groups (``a1,a2|b1;a3|b2``), links, and both numbers of tokens of each text."""
        split = [UNIT.findall(" " + t) if t else [] for t in texts]
        if len(self.recent) > REMEMBERED:
            self.recent, self.older = {}, self.recent
        new = list(set().union(*split).difference(self.recent))
        older = self.older
        self.recent.update((u, older[u]) for u in new if u in older)
        new = [u for u in new if u not in older]
        for i in range(0, len(new), TOGETHER):
            self.learn(new[i : i + TOGETHER])
        out = []
        for units in split:
            found = list(map(self.recent.__getitem__, units))
            if not found or None in found:
                out.append(("", b"", 0, 0))
                continue
            groups, links, n_a, n_b = zip(*found)
            out.append(("".join(groups)[:-1], b"".join(links), sum(n_a), sum(n_b)))
        for u in new:
            if len(u) > LONGEST:
                del self.recent[u]
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, links`` of ``doc_id, text``; ``links`` are packed as ``Aligner`` says."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path_a, path_b) not in _aligners:
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _aligners[path_a, path_b]
        for batch in batches:
            for i, j in slices(flat(batch.column(1))[1]):
                part = batch.slice(i, j - i)
                groups, links, n_a, n_b = zip(*aligner.align(part.column(1).to_pylist()))
                n_groups = [len(x) // 4 for x in links]
                columns = [part.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(groups, pa.string()), pa.array(links, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, kinds)


def link_counts(rows: DataFrame) -> DataFrame:
    """``link, n``: how often each link occurs in the ``links`` of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(0))
            for i, j in slices(off):
                link, n = np.unique(np.frombuffer(data[off[i] : off[j]].tobytes(), "<u4"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(link.astype(np.int64)), pa.array(n, pa.int64())], ["link", "n"])

    return rows.select("links").mapInArrow(count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def with_link_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``rows``, a written table of alignments, with ``n_links``, ``n_best`` (links whose count is the highest of their second id) and ``count_sum``."""
    spark, v = rows.sparkSession, Vocabularies(path_a, path_b)
    counts = written(link_counts(rows), "links").orderBy("link").toArrow()
    if counts.num_rows > v.bound():
        raise ValueError("more links than two tokens that end together can make")
    link, n = counts.column("link").to_numpy(), counts.column("n").to_numpy()
    highest = np.zeros(v.n_b, np.int64)
    np.maximum.at(highest, link % v.n_b, n)
    known = spark.sparkContext.broadcast((link, n, n == highest[link % v.n_b]))
    others = [c for c in rows.columns if c != "links"]
    kept = rows.select(*others, "links")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n, best = known.value
        for batch in batches:
            data, off = flat(batch.column(len(others)))
            for i, j in slices(off):
                at = np.searchsorted(link, np.frombuffer(data[off[i] : off[j]].tobytes(), "<u4").astype(np.int64))
                cut = (off[i : j + 1] - off[i]) // 4
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[cut])
                made = [pa.array(np.diff(cut)), pa.array(total(best[at].astype(np.int64))), pa.array(total(n[at]))]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], *made], [*others, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "links")
    return kept.mapInArrow(add, f"{kinds}, n_links long, n_best long, count_sum long")
