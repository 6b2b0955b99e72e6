"""SentencePiece encoding and decoding as a relational lattice.

Documents are dealt into blocks of about BLOCK_BYTES of text, and each block names its distinct words (a word keeps the blanks and signs
before its letters; no piece of the vocabulary reaches beyond one). Every distinct word of the corpus is exploded once into substrings
of bounded length, which meet the piece table by an equi-join; the edges are grouped by word, and a higher-order ``aggregate`` folds
each word's lattice to the places where its pieces end. These go back to the blocks that named the word. A block's documents
and its words then meet in one task, which puts the ids of words together and decodes them again.

The vocabulary is byte-pair encoding, whose result is not the path of largest summed score: a Viterbi fold of sums gives other
pieces than the library. The fold therefore keeps which boundaries still stand, one byte a place, and walks the edges once from the
best score to the worst: an edge that finds both its ends and one boundary between them takes that boundary away. That is what the
library's queue does as long as no piece scores better than the two parts it is last made of, for then every edge that
a step makes possible is still to come; ``Vocabulary`` checks it for all pieces. Equal scores, of runs of blanks only, go by their ends,
the shorter first. Characters that are no piece become bytes. Words of any length take this one way.

Null and empty texts have no ids. A null doc_id is kept, repeated rows each give a row and may fall into different blocks, texts
of any length are encoded whole, an empty table gives an empty result and further columns are ignored. The vocabulary must be byte-pair
encoding with byte fallback and without normalization, which ``Vocabulary`` checks too.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import flat, slices

#: The blank of pieces; what stands from one blank to the next; and a word of it: blanks, what is no letter, letters (three digits
#: count as signs because a piece joins one with a point).
BLANK = "▁"
LETTER, OTHER = r"[^\W\d_¹²³]", rf"(?:[^\w{BLANK}]|[\d_¹²³])"
WORD = re.compile(f"{BLANK}*(?:{OTHER}*{LETTER}+|{OTHER}+)|{BLANK}+")
UNIT = re.compile(f"{BLANK}+[^{BLANK}]*")
#: Bytes of text in a block; less where there are not so many blocks as cores, but not below the second.
BLOCK_BYTES, LEAST_BYTES = 32 << 20, 2 << 20
#: Words that are Python's at one time; Arrow holds the others in less room.
STEP = 50_000


def units_of(text: str) -> list[str]:
    """A text cut before its blanks, each unit without its first blank; a text begins with a blank of its own unless it is empty."""
    text = text.replace(BLANK, " ")
    if text.startswith(" ") or "  " in text:
        return [unit[1:] for unit in UNIT.findall((" " + text).replace(" ", BLANK))]
    return text.split(" ") if text else []


def units_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Places of all texts, how many units each has, and their units; texts without runs of blanks are cut by Arrow."""
    blanked = pc.replace_substring(texts, BLANK, " ")
    odd = pc.or_(pc.match_substring(blanked, "  "), pc.or_(pc.starts_with(blanked, " "), pc.equal(blanked, "")))
    at, plain = pc.indices_nonzero(odd), pc.invert(odd)
    few = pa.array([units_of(text) for text in texts.take(at).to_pylist()], pa.list_(pa.string()))
    cut = pa.concat_arrays([pc.split_pattern(blanked.filter(plain), " "), few])
    return pa.concat_arrays([pc.indices_nonzero(plain), at]), cut.value_lengths().to_numpy(), cut.flatten()


def distinct(values: list[pa.Array]) -> tuple[pa.Array, list[pa.Array]]:
    """The distinct values of some arrays, and for each array where its values stand among them."""
    coded = iter(pa.chunked_array([v for v in values if len(v)], pa.string()).dictionary_encode().chunks)
    codes = [next(coded) if len(v) else None for v in values]
    found = next((c.dictionary for c in codes if c is not None), pa.array([], pa.string()))
    return found, [pa.array([], pa.int32()) if c is None else c.indices for c in codes]


def words_of(units: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of units in order, the place among them of each word of each unit, and how many words each unit has."""
    counts: list[int] = []

    def found() -> Iterator[str]:
        for a in range(0, len(units), STEP):
            for unit in units.slice(a, STEP).to_pylist():
                words = WORD.findall(BLANK + unit)
                counts.append(len(words))
                yield from words

    words, (codes,) = distinct([pa.array(found(), pa.string())])
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return words.take(pa.array(order)), place[codes.to_numpy()], np.array(counts, np.int64)


def joined(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Each run of so many values, one after the other, as one."""
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset :][np.concatenate([[0], np.cumsum(counts)])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), data])


def _batch(data: bytes | pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_next_batch()


def plain(decoded: bytes) -> str:
    """Decoded bytes as text, without the blank that encoding puts before it."""
    return decoded.removeprefix(b" ").decode("utf-8", "replace")


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: list[int] = [0] * 256
        self.text: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            control = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            self.text.append(b"" if control else piece.replace(BLANK, " ").encode())
            if not control:
                self.pieces[piece] = (i, model.get_score(i))
        if not any(self.bytes) or any(len(WORD.findall(p)) > 1 for p in self.pieces):
            raise ValueError(f"{path}: pieces must not reach over words and bytes must have pieces")
        if model.encode("ａ  b", out_type=str)[0] != BLANK:
            raise ValueError(f"{path}: the text must not be normalized")
        self.longest = max(map(len, self.pieces))
        for piece, (_, score) in self.pieces.items():
            halves = self._last_halves(piece) if len(piece) > 1 else ()
            worst = min((self.pieces[h][1] for h in halves if len(h) > 1), default=math.inf)
            if len(halves) == 1 or worst < score or (worst == score and piece.strip(BLANK)):
                raise ValueError(f"{path}: {piece!r} scores better than what it is made of")

    def table(self, spark: SparkSession) -> DataFrame:
        """``piece, rank`` of pieces of several characters, the best score first; its size is the vocabulary's, whatever the corpus."""
        ranks = {score: n for n, score in enumerate(sorted({s for _, s in self.pieces.values()}, reverse=True))}
        rows = [(p, ranks[s]) for p, (_, s) in self.pieces.items() if len(p) > 1]
        return spark.createDataFrame(pa.table(list(zip(*rows)), ["piece", "rank"]))

    def _last_halves(self, piece: str) -> list[str]:
        """The two symbols that encoding the piece's own text joins last; the whole text if it does not end in one symbol."""
        symbols, before = list(piece), []
        while len(symbols) > 1:
            joins = [(-self.pieces[x + y][1], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in self.pieces]
            if not joins:
                return [piece]
            before, i = symbols, min(joins)[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return before

    def cut(self, word: str, stand: bytes | None) -> list[int]:
        """The ids of a word whose pieces end where ``stand`` has a 1 (without one, its characters); a character that is no piece gives its bytes."""
        out, a = [], 0
        for gap in b"1" * len(word) if stand is None else stand.split(b"1")[1:-1]:
            b = a + 1 if stand is None else a + 1 + len(gap)
            found = self.pieces.get(word[a:b])
            if found:
                out.append(found[0])
            else:
                out += [self.bytes[x] for x in word[a:b].encode()]
            a = b
        return out

    def coded(self, word: str, stand: bytes | None) -> tuple[bytes, bytes]:
        """A word's ids as little-endian unsigned 32-bit numbers, and what they decode to."""
        ids = self.cut(word, stand)
        return array("I", ids).tobytes(), b"".join(map(self.text.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the blank that encoding puts before it."""
        return plain(b"".join(map(self.text.__getitem__, ids)))


def folded(words: DataFrame, vocabulary: Vocabulary, keys: list[str]) -> DataFrame:
    """``keys, word, stand`` of distinct rows ``keys, word``: byte i of ``stand`` is 1 where a piece ends before character i, else 0.

    Words in which no two characters make a piece are left out: their pieces are their characters.
    """
    ranked = F.broadcast(vocabulary.table(words.sparkSession))
    n = F.length("word")
    ends = words.select(*keys, "word", F.explode(F.sequence(F.lit(2), F.greatest(n, F.lit(2)))).alias("end"))
    parts = ends.select(*keys, "word", "end", F.explode(F.sequence(F.lit(2), F.least("end", F.lit(vocabulary.longest)))).alias("size"))
    edges = parts.withColumn("piece", F.substring("word", F.col("end") - F.col("size") + 1, F.col("size"))).join(ranked, "piece")
    # An edge as one number that sorts by rank, then by end, then by length.
    number = F.shiftleft("rank", 40) + F.shiftleft(F.col("end").cast("long"), 8) + F.col("size")
    # The hash stands first among the keys: sorting compares one number instead of texts.
    lattice = edges.groupBy(F.xxhash64("word").alias("hash"), "word", *keys).agg(F.sort_array(F.collect_list(number)).alias("edges"))
    gone = F.array(*(F.lit(b"0" * k) for k in range(vocabulary.longest)))

    def step(stand, edge):
        size = edge.bitwiseAND(255).cast("int")
        first = F.shiftright(edge, 8).bitwiseAND(2**32 - 1).cast("int") - size + 1  # of the edge, counted from 1
        seen = F.substring(stand, first, size + 1).cast("string")
        fits = seen.startswith("1") & seen.endswith("1") & (F.length(F.replace(seen, F.lit("0"))) == 3)
        return F.when(fits, F.overlay(stand, F.get(gone, size - 1), first + 1)).otherwise(stand)

    all_stand = F.repeat(F.lit("1"), F.length("word") + 1).cast("binary")
    return lattice.select(*keys, "word", F.aggregate("edges", all_stand, step).alias("stand"))


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, round_trip`` [, ``ids``] of every row: the ids' CRC as little-endian unsigned 32-bit numbers, and whether decoding gives the text (with U+2581 as a blank)."""
    vocabulary = Vocabulary(path)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Some megabytes of rows as one compressed value: texts shrink to a third before they are shuffled."""
        for batch in batches:
            for a, b in slices(flat(batch.column("text"))[1]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(sink.getvalue(), 6)], pa.binary())], ["rows"])

    # Packs of rows, not ids, are dealt: a repeated id is spread too.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = docs.mapInArrow(pack, "rows binary").select(block.alias("block"), "rows").repartitionById(blocks, F.col("block"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of a block, which is one partition, numbered in their order."""
        numbers: list[int] = []

        def units() -> Iterator[pa.Array]:
            for batch in batches:
                numbers.extend(batch.column("block").to_pylist())
                for r in batch.column("rows"):
                    yield units_in(_batch(r.as_buffer()).column("text"))[2].unique()

        words = words_of(distinct(list(units()))[0])[0]
        for i in range(0, len(words), STEP):
            part = words.slice(i, STEP)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(numbers[0], pa.int32()), len(part)), pa.array(range(i, i + len(part)), pa.int32()), part], ["block", "number", "word"])

    # No column may be null or is left out, so that both uses of the dealt texts, and of the names, share one shuffle.
    kinds = {"block": T.IntegerType(), "number": T.IntegerType(), "word": T.StringType()}
    names = dealt.mapInArrow(name, T.StructType([T.StructField(c, k, False) for c, k in kinds.items()])).repartition(2 * blocks, "word")
    each = names.groupBy("word").agg(F.min(F.struct("block", "number")).alias("first"))
    lattice = folded(each, vocabulary, ["first"]).withColumnRenamed("word", "same").hint("shuffle_hash")
    known = names.join(lattice, F.col("word") == F.col("same"), "left").select(F.col("block").alias("in_block"), "number", "stand", F.col("first.number").alias("first"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def put_together(packs: pa.Table, known: pa.Table) -> pa.Table:
        rows = [_batch(r.as_buffer()) for r in packs.column("rows")]
        at, counts, flats = zip(*(units_in(r.column("text")) for r in rows))
        units, used = distinct(flats)
        del flats
        words, places, sizes = words_of(units)
        row_of = np.full(len(words), -1)
        row_of[known.column("number").to_numpy()] = np.arange(len(known))
        stands = known.column("stand").combine_chunks().take(pa.array(row_of, mask=row_of < 0))
        coded: tuple[list[pa.Array], ...] = ([pa.array([], pa.large_binary())], [pa.array([], pa.large_binary())])
        for a in range(0, len(words), STEP):
            part = map(vocabulary.coded, words.slice(a, STEP).to_pylist(), stands.slice(a, STEP).to_pylist())
            for values, found in zip(coded, zip(*part)):
                values.append(pa.array(found, pa.large_binary()))
        # What an id decodes to does not depend on its neighbours: words give units, units give texts.
        ids_of, texts_of = (joined(pa.concat_arrays(values).take(pa.array(places)), sizes) for values in coded)
        out = []
        for r, places, n, codes in zip(rows, at, counts, used):
            ids, decoded = (joined(values.take(codes), n) for values in (ids_of, texts_of))
            for doc, text, i, d in zip(r.column("doc_id").take(places).to_pylist(), r.column("text").take(places).to_pylist(), ids, decoded.to_pylist()):
                i = i.as_buffer()
                row = (doc, i.size // 4, zlib.crc32(i), plain(d) == text.replace(BLANK, " "))
                out.append((*row, np.frombuffer(i, "<u4").astype(np.int32)) if with_ids else row)
        columns = list(zip(*out)) or [()] * len(schema)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    return dealt.groupBy("block").cogroup(known.repartitionById(blocks, F.col("in_block")).groupBy("in_block")).applyInArrow(lambda a, b: put_together(a, b), schema)
