"""URL filters: explicit rules, then word segmentation of hosts and a multinomial naive Bayes model.

1. A rule is a host and a path. It fits a url whose host is the rule's or lies below it and whose path starts with the rule's;
   of several the longest wins and gives the verdict.
2. Words are counted in the visible text of all pages. Letter runs of the distinct hosts become lattices: their substrings of
   bounded length meet the word counts by an equi-join, and a Viterbi search under the unigram model splits concatenated names.
3. The verdicts of urls that a rule fits train the naive Bayes model over segmented host words and path words, hashed into BUCKETS
   buckets. What a rule names, its host's labels and its path's words, is no feature of any url: the model would only learn the rules
   again. It judges all other urls; without a word or without training urls of both kinds it allows.

Hosts and letter runs are counted by partial aggregation, and the results of frequent ones are broadcast: a host of many pages is no task's alone.

Null urls and urls without ``://`` have empty host and path and no rule. Runs of over LABEL letters, more than a host's label can
hold, stay one word. Repeated rows each get a verdict, a null page_id is kept, rules of equal length are taken in their
order, an empty table gives an empty result; further columns are ignored, null html has no words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spread_join, written

Rule = tuple[str, str, str]
#: Longest word of the unigram model and longest letter run that is split (a host's label holds no more), buckets of the naive Bayes model.
WORD, LABEL, BUCKETS = 63, 63, 1 << 18
#: Log probability of a letter that no word covers, against the total count.
UNKNOWN = -14.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[a-z]+|[0-9]+|[^\W\d_]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path together, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, count`` over the visible text of all pages: words of 2 to WORD letters a-z."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return words.where(F.col("word").rlike(f"^[a-z]{{2,{WORD}}}$")).groupBy("word").agg(F.count("*").alias("count"))


def viterbi(run: str, edges: list[tuple[int, str, int]], total: int) -> list[str]:
    """The likeliest split of ``run``; ``edges`` are (start, word, count). Letters no word covers join into one word."""
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    ending: dict[int, list[tuple[int, int]]] = {}
    for start, word, count in edges:
        ending.setdefault(start + len(word), []).append((start, count))
    for end in range(1, len(run) + 1):
        ways = [(best[end - 1][0] + UNKNOWN, end - 1, False)]
        ways += [(best[s][0] + math.log(count / total), s, True) for s, count in ending.get(end, ())]
        best.append(max(ways))
    out, end, open_end = [], len(run), 0
    while end:
        _, start, known = best[end]
        if known:
            out.append(run[start:end])
        elif out and open_end == end:
            out[-1] = run[start:end] + out[-1]
        else:
            out.append(run[start:end])
        open_end = 0 if known else start
        end = start
    return out[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``run, n, words`` of ``runs`` (distinct letter runs, and how often they stand)."""
    total = counts.agg(F.sum("count")).first()[0] or 1
    short = runs.where(F.length("run") <= LABEL)
    starts = short.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    parts = starts.select("run", "at", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(WORD), F.length("run") - F.col("at") + 1)))).alias("n"))
    parts = parts.where(F.col("at") + F.col("n") - 1 <= F.length("run")).select("run", "at", F.substring("run", F.col("at"), F.col("n")).alias("word"))
    edges = parts.join(counts, "word").groupBy("run").agg(F.collect_list(F.struct((F.col("at") - 1).alias("at"), "word", "count")).alias("edges"))
    rows = runs.join(edges, "run", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [viterbi(r, [(e["at"], e["word"], e["count"]) for e in es or ()], total) if len(r) <= LABEL else [r] for r, es in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["run", "n", "words"])

    return rows.select("run", "n", "edges").mapInArrow(split, "run string, n long, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``hosts``, distinct in ``own``, with ``words``: their letter runs, split."""
    runs = hosts.select("own", F.posexplode(F.regexp_extract_all("own", F.lit("([a-z]+)"), 1)).alias("i", "run"))
    pieces = segmented(runs.groupBy("run").agg(F.count("*").alias("n")), counts)
    words = spread_join(runs, written(pieces, "runs"), "run", "n").groupBy("own").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"])).alias("words"))
    return hosts.join(words, "own", "left")


def tokens(words: list[str] | None, path: str, named: frozenset[str] = frozenset()) -> list[str]:
    """Features of a url: its host's words, and its path's but for segments in ``named``; a number counts by its length."""
    rest = "/".join(s for s in path.lower().split("/") if s not in named)
    found = (f"path:{'0' * len(t) if t[0].isdecimal() else t}" for t in _TOKEN.findall(rest))
    return [*(f"host:{w}" for w in words or ()), *found]


def _buckets(words: list[str] | None, path: str, named: frozenset[str]) -> list[int]:
    return [zlib.crc32(t.encode()) % BUCKETS for t in tokens(words, path, named)]


def log_odds(urls: DataFrame, named: frozenset[str] = frozenset()) -> tuple[np.ndarray, float]:
    """Log odds of ``block`` against ``allow`` for each bucket, and those of the kinds, from urls with a rule's verdict."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bool], int] = {}
        for batch in batches:
            for words, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                for b in (-1, *_buckets(words, path, named)):
                    key = (b, verdict == "block")
                    found[key] = found.get(key, 0) + 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], ["bucket", "block", "n"])

    rows = urls.where("said is not null").select("words", "path", "said").mapInArrow(count, "bucket long, block boolean, n long").groupBy("bucket", "block").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, BUCKETS + 1))
    counts[rows.block.astype(int), rows.bucket] = rows.n  # -1, the urls themselves, is the last column
    urls_of = counts[:, -1]
    if not urls_of.all():
        return np.zeros(BUCKETS), -1.0
    seen = (counts[:, :-1].sum(axis=0) > 0).sum()
    share = (counts[:, :-1] + 1) / (counts[:, :-1].sum(axis=1, keepdims=True) + seen)
    odds = np.where(counts[:, :-1].sum(axis=0) > 0, np.log(share[1]) - np.log(share[0]), 0.0)
    return odds, float(np.log(urls_of[1] / urls_of[0]))


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, words, log_odds`` of every page; ``words`` and ``log_odds`` leave out what the rules name."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    labels = sorted({label for name, _, _ in rules for label in name.split(".")})
    own = F.array_join(F.array_except(F.split("host", r"\."), F.array(*map(F.lit, labels))), ".")
    urls = urls.withColumns({"rule": rule, "said": said, "own": own})
    counts = written(word_counts(pages), "words")
    hosts = urls.groupBy("own").agg(F.count("*").alias("n"))
    urls = written(spread_join(urls, written(host_words(hosts, counts), "hosts"), "own", "n"), "urls")
    named = frozenset(segment.lower() for _, start, _ in rules for segment in start.split("/") if segment)
    odds, base = log_odds(urls, named)
    bound = pages.sparkSession.sparkContext.broadcast(odds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [base + float(bound.value[_buckets(w, p, named)].sum()) for w, p in zip(batch.column("words").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], [*batch.schema.names, "log_odds"])

    rows = urls.select("page_id", "host", "path", "rule", "said", "words")
    rows = rows.mapInArrow(score, "page_id long, host string, path string, rule string, said string, words array<string>, log_odds double")
    verdict = F.coalesce("said", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", F.round("log_odds", 6).alias("log_odds"))
