"""Toxicity behind disguises: a noisy channel restores words, a classifier scores the restored text.

1. A character trigram model and hashed counts of words are taken over all documents.
2. Words that look disguised (digits or signs before, among or after letters, a letter three times or more, letters set apart by
   blanks or points) become a lattice of the letters each character may stand for. A Viterbi search under the channel's
   costs and the character model picks the likeliest spelling, which takes the word's place in the text. Letters set apart
   may be several words: any separator may end one, a wider one most likely does; frequent words cost what their counts say. Words and rows of letters of any length are decoded, but a word of over REMEMBERED
   letters within a row is none of the counted ones, and words that began over 2 * REMEMBERED runs ago are no longer told apart.
3. A word's marks are its hash and those of its prefixes of 4 to 8 bytes; a feature is a mark that at least 1, 2 or 3 of a
   text's distinct words bear. From a bounded sample of labelled rows (TRAIN_ROWS, chosen by hash; copies and near copies
   count once) the classifier takes the features whose presence marks toxic texts beyond doubt, then weaker ones as long as they
   explain toxic rows that those before don't. The score is the logistic function of the log odds of a text without
   any, plus fixed shares of those of its strongest feature and of its others (which mostly restate it).

Only ids whose crc32 modulo 4 is not HELD are learnt from; no label, language, source or id enters a score. Null and empty
texts score as texts without a feature. Rows with a null doc_id count as not held out. Without labels of both
kinds all rows score the base rate. Repeated rows get equal rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import flat, slices, written
from tidemark.llm.texthash import SPACES, shingles, span_hashes, word_spans, words

HELD, FOLDS, THRESHOLD = 2, 4, 0.3
TRAIN_ROWS = 12_000
#: Features that the classifier chooses from: those in most toxic rows of the sample.
FEATURES = 12_000
BUCKETS = 1 << 20
PREFIXES, LEVELS = (4, 5, 6, 7, 8), 3
#: A feature is taken if its log odds less two standard errors are SURE_ODDS or more; or if they are MIN_ODDS or more
#: and it stands in MIN_ROWS toxic rows or more, and MIN_SHARE of them, that no other feature explains (fewer may be
#: mislabelled). Either way toxic rows that have it must outnumber others MIN_RATIO to one.
MIN_ROWS, MIN_SHARE, MIN_RATIO, MIN_ODDS, SURE_ODDS = 3, 0.02, 8, 1.0, 2.0

#: The shares of log odds that a text's strongest feature adds, and its others.
STRONGEST, OTHERS = 0.75, 0.1

#: What a character may stand for besides itself (fixed values).
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Costs, in nats, of a sign for a letter, a sign kept, a letter dropped from a run, a separator dropped.
SIGN, KEPT, DROPPED, APART = 1.0, 6.0, 0.3, 0.2
#: Costs of a separator that ends a word (besides the character model's); of a wider one that does not, or a narrow one that does beside wider ones.
BREAK, UNLIKE = 0.2, 8.0
#: Cost of a word that is not among the counted ones; spellings this much dearer than the best so far are given up while letters are set apart.
OPEN, BEAM = 3.0, 30.0
#: Buckets of each of two tables of word counts; words no more frequent than a bucket's mean are not told from chance.
WORDS = 1 << 20
#: A line's end is as wide as so many blanks.
LINE = 8
#: Runs between two looks for what all spellings share; longer words are not remembered.
STEP, REMEMBERED = 64, 64

_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[65:91] = np.arange(1, 27)
_IS_LETTER = _LETTER > 0
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in STANDS_FOR]] = True
#: Those that are no punctuation after a letter.
_TAIL = _SIGN.copy()
_TAIL[[ord(c) for c in "!|"]] = False
_BLANKS = " \t\n\v\f\r"
_APARTS = re.compile(r"[._*-]|[ \t\n\v\f\r]+")
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in "._-*"]] = True


class CharModel:
    """Trigram log probabilities over a-z and the word's edge (0), from a 27 x 27 x 27 array of counts; and frequent words' by bucket."""

    def __init__(self, counts: np.ndarray, frequent: np.ndarray | None = None):
        counts = counts.reshape(27, 27, 27).astype(float)
        back = counts.sum(axis=0) + 0.5
        back /= back.sum(axis=1, keepdims=True)
        smooth = counts + 5 * back[None]
        self.log = np.log(smooth / smooth.sum(axis=2, keepdims=True)).tolist()
        #: Log probabilities of words by bucket, of both tables in one array; minus infinity where there is no frequent word.
        self.frequent = frequent

    def word_cost(self, word: str) -> float:
        """Cost of a word by its frequency."""
        if self.frequent is None or not word:
            return math.inf
        data = np.frombuffer(word.encode(), np.uint8)
        one, two = word_buckets(span_hashes(data, np.array([0]), np.array([len(data)])))
        return -float(min(self.frequent[one[0]], self.frequent[two[0]]))

    def restore(self, word: str) -> str:
        """The likeliest letters behind ``word`` (lower case)."""
        runs: list[tuple[str, int]] = []
        for c in word:
            n = LINE if c in "\n\r" else 1
            c = " " if c in _BLANKS else c
            if runs and runs[-1][0] == c:
                runs[-1] = (c, runs[-1][1] + n)
            else:
                runs.append((c, n))
        letters_apart = sum(len(r) == 1 for r in _APARTS.split(word)) >= 3
        gaps = [n for c, n in runs if c in "._-* "] if letters_apart else []
        narrow, wide = (min(gaps), max(gaps)) if gaps else (1, 1)
        # Best spelling by the word's start (if letters are set apart) and the last two letters: its cost, its cost without the current word's letters,
        # the words before and the current one. What all spellings share goes to done.
        cost_of = lru_cache(1 << 12)(self.word_cost)
        best: dict[tuple[int, int, int], tuple[float, float, str, str]] = {(0, 0, 0): (0.0, 0.0, "", "")}
        done: list[str] = []
        for at, (c, n) in enumerate(runs, 1):
            ways: list[tuple[str, float]] = []
            if "a" <= c <= "z":
                ways = [(c * k, DROPPED * (n - k)) for k in ((1, 2) if n > 2 else (n,))]
            elif c in STANDS_FOR:
                # Two signs are two letters; of a longer run one or two.
                ways = [(x * k, SIGN * n) for x in STANDS_FOR[c] for k in ((1, 2) if n > 2 else (n,))]
                ways.append((c * n, KEPT * n))
            elif c in "._-* " and letters_apart:
                ways = [("", APART + UNLIKE * (n > narrow))]
            else:
                ways = [(c * n, 0.0)]
            after: dict[tuple[int, int, int], tuple[float, float, str, str]] = {}
            for (start, p, q), (cost, plain, text, own) in best.items():
                if gaps and start >= 0 and at - start > 2 * REMEMBERED:
                    start = -1
                for letters, price in ways:
                    a, b, total = p, q, cost + price
                    for x in letters:
                        i = ord(x) - 96 if "a" <= x <= "z" else 0
                        total -= self.log[a][b][i]
                        a, b = b, i
                    if (start, a, b) not in after or total < after[start, a, b][0]:
                        after[start, a, b] = (total, plain + price, text, own + letters) if len(own) <= REMEMBERED else (total, math.inf, text + own, letters)
                if ways[0][0] == "":
                    total = min(cost - self.log[p][q][0] + OPEN, plain + cost_of(own)) + BREAK + UNLIKE * (n == narrow < wide)
                    if (at, 0, 0) not in after or total < after[at, 0, 0][0]:
                        after[at, 0, 0] = (total, total, text + own + " ", "")
            if gaps:
                bound = min(v[0] for v in after.values()) + BEAM
                after = {k: v for k, v in after.items() if v[0] <= bound}
            best = after
            if at % STEP == 0:
                done.append(commonprefix([v[2] for v in best.values()]))
                best = {k: (cost, plain, text[len(done[-1]) :], own) for k, (cost, plain, text, own) in best.items()}
        ends = ((min(cost - self.log[a][b][0] + OPEN, plain + cost_of(own)) if gaps else cost - self.log[a][b][0], text + own) for (_, a, b), (cost, plain, text, own) in best.items())
        return "".join(done) + min(ends)[1]


def word_buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words' hashes in both tables of word counts."""
    return (hashes >> np.uint64(44)).astype(np.int64), (hashes & np.uint64(WORDS - 1)).astype(np.int64) + WORDS


def char_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Trigram counts of letters within words; two edges stand before a word and one after."""
    if not len(data):
        return np.zeros(27**3, np.int64)
    kind = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    one = np.concatenate([[0], kind[:-1]])
    one[edge[:-1]] = 0
    two = np.where(one > 0, np.concatenate([[0, 0], kind[:-2]])[: len(kind)], 0)
    two[np.concatenate([[True], edge[:-2]])] = 0
    some = (kind > 0) | (one > 0)
    counts = np.bincount((two * 27 + one)[some] * 27 + kind[some], minlength=27**3)
    ends = np.flatnonzero(kind[np.maximum(off[1:] - 1, 0)] * (np.diff(off) > 0))
    last = off[1:][ends] - 1
    return counts + np.bincount((one[last] * 27 + kind[last]) * 27, minlength=27**3)


def word_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of words by bucket, of both tables in one array."""
    start, end = word_spans(data, off, _BREAKS)
    return np.bincount(np.concatenate(word_buckets(span_hashes(data, start, end))), minlength=2 * WORDS)


def frequent_words(bucket: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """Log probabilities by bucket from the counts of some of ``total`` words."""
    out = np.full(2 * WORDS, -np.inf, np.float32)
    out[bucket] = np.log(n / total)
    return out


def char_model(docs: DataFrame) -> CharModel:
    """The character model and the frequent words of all texts; each task sends its counts of grams and of buckets."""
    grams = 27**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grams + 2 * WORDS, np.int64)
        for batch in batches:
            data, off = flat(batch.column(0))
            for a, b in slices(off):
                own, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                total[:grams] += char_counts(own, at)
                total[grams:] += word_counts(own, at)
        some = np.flatnonzero(total)
        for i in range(0, len(some), 1 << 16):
            at = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = written(docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    words_in = (rows.where(F.col("gram") >= grams).agg(F.sum("n")).first()[0] or 0) // 2
    found = rows.where((F.col("gram") < grams) | (F.col("n") > words_in / WORDS)).toPandas()
    counts = np.zeros(grams, np.int64)
    letters = found[found.gram < grams]
    counts[letters.gram] = letters.n
    frequent = found[found.gram >= grams]
    return CharModel(counts, frequent_words(frequent.gram.to_numpy() - grams, frequent.n.to_numpy(), words_in))


class Restorer:
    """Texts with their disguised words restored; spellings found are remembered up to a bound."""

    def __init__(self, model: CharModel):
        self.model = model
        self.spell = lru_cache(1 << 16)(model.restore)

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        # A sign at either end is punctuation unless it stands for a letter among digits and letters.
        low = text.strip(".,;:?\"'()[]{}<>!*_-").lower()
        spell = self.spell if len(low) <= REMEMBERED else self.model.restore
        return spell(low).encode() if low else raw

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = word_spans(data, off)
        if not len(start):
            return data, off
        letter, sign, apart = _IS_LETTER[data], _SIGN[data], _APART[data]
        mark = np.zeros(len(data), bool)
        mark[1:] |= sign[:-1] & letter[1:] | letter[:-1] & _TAIL[data[1:]]
        mark[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
        mark[4:] |= letter[4:] & apart[3:-1] & letter[2:-2] & apart[1:-3] & letter[:-4]
        marked = np.flatnonzero(mark)
        odd = np.zeros(len(start), bool)
        odd[np.searchsorted(start, marked, "right") - 1] = True
        # Three and more words of one character in a row are words set apart; the lattice finds where they end.
        single = (end - start == 1) & (letter[start] | sign[start])
        begins = np.isin(start, off)
        chain = single[1:] & single[:-1] & ~begins[1:]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], chain.astype(np.int8), [0]])))
        first, last = edge[::2], edge[1::2]
        long = last - first >= 2
        spans = [(int(start[i]), int(end[j])) for i, j in zip(first[long], last[long])]
        for i, j in zip(first[long], last[long]):
            odd[i : j + 1] = False
        spans += list(zip(start[odd].tolist(), end[odd].tolist()))
        if not spans:
            return data, off
        spans.sort()
        blob = data.tobytes()
        out, at, shift_at, shift = [], 0, [], []
        for a, b in spans:
            new = self.word(blob[a:b])
            if new != blob[a:b]:
                out += [blob[at:a], new]
                shift_at.append(a)
                shift.append(len(new) - (b - a))
                at = b
        out.append(blob[at:])
        moved = np.concatenate([[0], np.cumsum(shift)]).astype(np.int64)
        return np.frombuffer(b"".join(out), np.uint8), off + moved[np.searchsorted(shift_at, off)]


def buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words and their prefixes (0: none), one row a word, and each word's text."""
    start, end = word_spans(data, off, _BREAKS)
    text = np.searchsorted(off, start, "right") - 1
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    columns = [(span_hashes(data, start, end) >> shift).astype(np.int64)]
    for k in PREFIXES:
        longer = end - start > k
        part = np.zeros(len(start), np.int64)
        part[longer] = (span_hashes(data, start[longer], start[longer] + k) * np.uint64(2 * k + 1) >> shift).astype(np.int64)
        columns.append(part)
    return np.stack(columns, axis=1), text


#: Words end at white space and ASCII punctuation.
_BREAKS = SPACES.copy()
_BREAKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def marks(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and number of distinct words of every mark of each text, or of the ``wanted`` ones (an array of booleans)."""
    bucket, text = buckets(data, off)
    if wanted is not None:
        some = wanted[bucket].any(axis=1)
        bucket, text = bucket[some], text[some]
    _, first = np.unique(text * BUCKETS + bucket[:, 0], return_index=True)
    bucket, text = bucket[first], text[first]
    pairs, n = np.unique((text[:, None] * BUCKETS + bucket)[bucket > 0], return_counts=True)
    return pairs // BUCKETS, pairs % BUCKETS, np.minimum(n, LEVELS)


def likeness_key(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The smallest shingle hash of each text: copies and most near copies have the same."""
    h, at = shingles(*words(data, off))
    low = np.full(len(off) - 1, 2**63 - 1, np.int64)
    some = np.diff(at) > 0
    if some.any():
        low[some] = (np.minimum.reduceat(h, at[:-1][some]) >> np.uint64(1)).astype(np.int64)
    return low


def fit(docs: DataFrame, labels: DataFrame, model: CharModel) -> tuple[dict[tuple[int, int], float], float]:
    """Log odds by bucket and least number of words, and the log odds of a text without any. ``labels``: doc_id, toxic."""
    bound = docs.sparkSession.sparkContext.broadcast(model)
    rows = labels.where("doc_id is not null and toxic is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD)
    sample = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).dropDuplicates(["doc_id"])
    known = docs.join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(bound.value)
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            data, off = flat(batch.column(1))
            for a, b in slices(off):
                own, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                kind = likeness_key(own, at)
                doc, bucket, level = marks(*restorer(own, at))
                yield pa.RecordBatch.from_arrays([pa.array(kind[doc]), pa.array(toxic[a:b][doc]), pa.array(bucket), pa.array(level.astype(np.int32))], ["kind", "toxic", "bucket", "level"])

    seen = known.mapInArrow(present, "kind long, toxic int, bucket long, level int").groupBy("bucket", "kind").agg(F.max("toxic").alias("toxic"), F.max("level").alias("level"))
    seen = written(seen, "features")
    n = {r["toxic"]: r["count"] for r in seen.groupBy("kind").agg(F.max("toxic").alias("toxic")).groupBy("toxic").count().collect()}
    good, bad = n.get(0, 0), n.get(1, 0)
    if not good or not bad:
        return {}, 4.0 if bad else -4.0
    rows_at = lambda level, toxic: F.count_if((F.col("level") >= level) & (F.col("toxic") == toxic))
    levels = F.array(*(F.struct(F.lit(k).alias("least"), rows_at(k, 1).alias("p"), rows_at(k, 0).alias("n")) for k in range(1, LEVELS + 1)))
    by_bucket = seen.groupBy("bucket").agg(levels.alias("levels")).select("bucket", F.inline("levels"))
    odds = F.log((F.col("p") + 0.5) / (bad + 1)) - F.log((F.col("n") + 0.5) / (good + 1))
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    telling = by_bucket.where((F.col("p") >= MIN_ROWS) & (F.col("p") >= MIN_RATIO * F.col("n"))).withColumn("odds", odds).withColumn("sure", odds - 2 * error).where(F.col("sure") >= MIN_ODDS)
    # All of this stems from the bounded sample; FEATURES bounds the model.
    telling = telling.orderBy(F.desc("p"), "bucket", "least").limit(FEATURES).select("bucket", "least", "odds", "sure")
    has = seen.where("toxic = 1").join(F.broadcast(telling), "bucket").where("level >= least").select("kind", "bucket", "least", "odds", "sure").toPandas()
    facts = {(r.bucket, r.least): (r.odds, r.sure) for r in has.drop_duplicates(["bucket", "least"]).itertuples()}
    rows_of = {k: set(g) for k, g in has.groupby(["bucket", "least"]).kind}
    taken = {k: facts[k][0] for k in rows_of if facts[k][1] >= SURE_ODDS}
    covered = set().union(*(rows_of[k] for k in taken))
    least = max(MIN_ROWS, MIN_SHARE * bad)
    while True:
        rows_of = {k: left for k, s in rows_of.items() if len(left := s - covered) >= least}
        if not rows_of:
            break
        k = max(rows_of, key=lambda x: (len(rows_of[x]), facts[x][0], x))
        taken[k] = facts[k][0]
        covered |= rows_of[k]
    return taken, math.log((bad - len(covered) + 0.5) / (good + 0.5))


def with_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``score`` in place of text."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in others]
    model = char_model(docs)
    odds, base = fit(docs, labels, model)
    # The log odds of a mark by its number of words; a higher level includes the lower ones.
    slot = {k: i for i, k in enumerate(sorted({k for k, _ in odds}), 1)}
    of_bucket, weight = np.zeros(BUCKETS, np.int32), np.zeros((len(slot) + 1, LEVELS + 1))
    for (k, level), value in odds.items():
        of_bucket[k] = slot[k]
        weight[slot[k], level:] = np.maximum(weight[slot[k], level:], value)
    bound = docs.sparkSession.sparkContext.broadcast((model, of_bucket, weight, base))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of_bucket, weight, base = bound.value
        restorer = Restorer(model)
        for batch in batches:
            data, off = flat(batch.column("text"))
            most, total = np.zeros(len(batch)), np.zeros(len(batch))
            for a, b in slices(off):
                doc, bucket, level = marks(*restorer(data[off[a] : off[b]], off[a : b + 1] - off[a]), of_bucket > 0)
                w = weight[of_bucket[bucket], level]
                np.maximum.at(most, a + doc, w)
                np.add.at(total, a + doc, w)
            value = 1 / (1 + np.exp(-np.clip(base + STRONGEST * most + OTHERS * (total - most), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.round(value, 9))], [*names, "score"])

    return docs.mapInArrow(score, T.StructType([*others, T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    rows = with_score(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text, and any others) that do not score as toxic, unchanged and without a shuffle."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_score(whole, labels).where(F.col("score") < THRESHOLD).select("row.*")
