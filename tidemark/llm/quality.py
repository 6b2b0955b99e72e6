"""Quality by importance resampling: hashed n-gram models of good and of raw text, and Gumbel top-k.

Tokens are runs of letters, digits and non-ASCII bytes, and runs of punctuation. Unigrams and bigrams are hashed into
BUCKETS buckets. The raw model counts them over all documents; the target model over documents labelled good
(of those rows a bounded sample, TARGET_ROWS, chosen by hash). A document's log weight is the sum of its features' log ratios.
The sample of k documents without replacement is the k largest keys, log weight over TEMPERATURE plus Gumbel noise
drawn from the document's id; their k-th largest is found by counting, without a sort or a gather.
k is a budget that no weight sets: the share of good ones among the labelled rows, at the upper end of its interval (SURE standard errors), of all
documents; so that good ones are not left out for want of room, and chance decides which of the others take what is left of it.

Null and empty texts have no features: log weight 0. A null doc_id draws its noise as id 0. Equal keys fall to the smaller doc_id (null
as 0); rows of one id with equal keys are sampled together, so that such repeats may give more than k rows. Without labelled rows all
weights are 0 and every document is kept. Texts of any length count whole. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import flat, slices, written
from tidemark.llm.texthash import BYTE_VALUE, mix, span_hashes

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
TEMPERATURE, SURE = 1.0, 2.0
#: Pseudo-counts added to every bucket of either model, and those by which the target model is drawn towards the raw one (a bucket's mean).
PRIOR, SHRINK = 1.0, 20.0

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 word, 2 punctuation
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_NEXT = np.uint64(0xD6E8FEB86659FD93)
#: The one bigram that a token followed by itself counts as.
_AGAIN = np.uint64(0x2545F4914F6CDD1D)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text of each."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(data))
    token = kind[start] > 0
    start, end = start[token], end[token]
    text = np.searchsorted(off, start, "right") - 1
    h = span_hashes(data, start, end, BYTE_VALUE)
    same = text[1:] == text[:-1]
    pair = np.where(h[1:] == h[:-1], _AGAIN, mix(h[:-1] * _NEXT + h[1:]))[same]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (np.concatenate([h, pair]) >> shift).astype(np.int64), np.concatenate([text, text[1:][same]])


def counted(docs: DataFrame) -> DataFrame:
    """``bucket, raw, target``: feature counts over all rows of ``good, text``, and over those with ``good``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False)
            data, off = flat(batch.column(1))
            for a, b in slices(off):
                bucket, text = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[a:b][text]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    return docs.select("good", "text").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame, good_ids: DataFrame) -> np.ndarray:
    """The models' log ratio for each bucket. ``good_ids`` has doc_id of at most TARGET_ROWS labelled rows."""
    sample = F.broadcast(good_ids.select("doc_id").distinct().withColumn("good", F.lit(True)))
    table = counted(docs.join(sample, "doc_id", "left")).toPandas()
    raw, target = np.full(BUCKETS, PRIOR), np.full(BUCKETS, PRIOR)
    raw[table.bucket] += table.raw
    target[table.bucket] += table.target
    if target.sum() == BUCKETS * PRIOR:
        return np.zeros(BUCKETS)
    # The smaller model is smoothed towards the raw one, so that what the target has not seen is not held against a text.
    target += SHRINK * BUCKETS * raw / raw.sum()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_features and log_weight in place of text."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in others]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column("text"))
            n, total = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1)
            for a, b in slices(off):
                bucket, text = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                n[a:b] = np.bincount(text, minlength=b - a)
                total[a:b] = np.bincount(text, model.value[bucket], minlength=b - a)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n), pa.array(np.round(total, 9))], [*names, "n_features", "log_weight"])

    return docs.mapInArrow(weigh, T.StructType([*others, T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())]))


def gumbel_key(temperature: float) -> Column:
    """Log weight over temperature, plus the noise of the document's id."""
    uniform = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.col("log_weight") / temperature - F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, key: str, k: int) -> float | int:
    """The k-th largest value of ``key``, by counts in ever finer bins; the driver sees 4096 counts a round."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low < high:
        width = (high - low) / 4096
        # A range too narrow for bins holds few values, which are counted one by one.
        bin_of = F.col(key) if low + width == low else F.least(F.floor((F.col(key) - low) / width), F.lit(4095))
        counts = rows.where(F.col(key).between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("bin")).collect()
        # Rows above ``high`` were taken off k in earlier rounds.
        for c in counts:
            if k <= c["n"]:
                low, high = c["low"], c["high"]
                break
            k -= c["n"]
    return high


Sampler = Callable[[Column], Column]


def _sampler(rows: DataFrame, k: int) -> Sampler:
    """Which rows of ``rows`` (doc_id, gumbel_key) are the k of largest key, given a row's key; the driver sees counts only."""
    least = kth_largest(rows, "gumbel_key", k) if k else None
    if least is None:
        return lambda key: F.lit(False)
    tied = rows.where(F.col("gumbel_key") == least).select((-F.coalesce("doc_id", F.lit(0))).alias("id"))
    above = rows.where(F.col("gumbel_key") > least).count()
    last = -kth_largest(tied, "id", k - above)
    return lambda key: (key > least) | ((key == least) & (F.coalesce("doc_id", F.lit(0)) <= last))


def good_share(labels: DataFrame, sure: float = SURE) -> float:
    """The share of rows labelled good, ``sure`` standard errors above what is seen; 1 without labels."""
    n, good = labels.where("quality in (0, 1)").agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    seen = good / n if n else 1.0
    return min(1.0, seen + sure * (seen * (1 - seen) / max(n, 1)) ** 0.5)


def _sampling(docs: DataFrame, labels: DataFrame, temperature: float, share: float | None, k: int | None) -> tuple[DataFrame, np.ndarray, Sampler]:
    """Weights and keys of ``doc_id, text``, the models' log ratios, and the choice of rows by their keys."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    ratios = log_ratios(docs, good)
    rows = written(weighed(docs, ratios).withColumn("gumbel_key", gumbel_key(temperature)), "weighed")
    n = rows.count()
    if k is None:
        k = -int(-n * (good_share(labels) if share is None else share) // 1)
    return rows, ratios, _sampler(rows, min(k, n))


def resampled(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", temperature: float = TEMPERATURE, share: float | None = None, k: int | None = None) -> DataFrame:
    """``doc_id, n_features, log_weight, gumbel_key, sampled`` of every row of ``docs``; ``labels`` has doc_id and quality (0 or 1).

    ``k`` documents are sampled, or else ``share`` of all, or else ``good_share``.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows, _, sampled = _sampling(docs, labels, temperature, share, k)
    return rows.withColumn("sampled", sampled(F.col("gumbel_key")))


def sampled_documents(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, share: float | None = None, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text, and any others) that are sampled, unchanged and without a shuffle: a second pass weighs them again."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, ratios, sampled = _sampling(narrow, labels, temperature, share, k)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return weighed(whole, ratios).where(sampled(gumbel_key(temperature))).select("row.*")
