"""Exact duplicates, the Merkle manifest and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.helpers import docs, odd_texts, sentence

pytest.importorskip("tidemark.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import alignment, exact_dedup, merkle  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Exact duplicates.


def exact(rows):
    """By its definition; of rows equal in id and text one stays."""
    groups, out = {}, []
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), H(t or "")))
    return out, len(groups)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup(spark, batches):
    rng = random.Random(3)
    texts = [*odd_texts(), "A b", "a b", "a  b"]
    rows = [(i, rng.choice(texts)) for i in range(-20, 60)] + [(None, ""), (None, "only here"), (None, "only here"), (59, "twice"), (59, "twice")]
    got = exact_dedup.deduplicated(docs(spark, rows), batches=batches).collect()
    want, groups = exact(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(want)
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_index_outlives_its_session_object(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first, then = docs(spark, [(1, "a"), (2, "a"), (3, "b")]), docs(spark, [(9, "a"), (7, "c"), (8, "c")])
    exact_dedup.DigestIndex(spark, path, 3).add(exact_dedup.digested(first, "first"))
    index = exact_dedup.DigestIndex(spark, path, 99)
    assert index.buckets == 3
    batch = exact_dedup.digested(then, "then")
    index.add(batch)
    index.add(batch)  # as after a failure
    assert index.rows().count() == 3
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.resolved(batch).collect()}
    assert got == {9: (2, 1, False), 7: (8, 2, False), 8: (8, 2, True)}


def test_index_is_merged_bucket_by_bucket(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 8)
    batch = exact_dedup.digested(docs(spark, [(i, str(i)) for i in range(50)]), "one")
    index.add(batch)
    plan = index.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan
    assert "Bucketed: true" in plan
    of_index = plan[: plan.index("FileScan parquet spark_catalog.default.digests")].splitlines()[-4:]
    assert not any("Exchange" in line for line in of_index), plan


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.deduplicated(docs(spark, [])).count() == 0


# The manifest.


def by_hand(rows):
    """The manifest of (doc_id, source, lang, n_chars, text) rows: root, and rows of (doc_id, leaf, subroot, proof)."""

    def leaf(row):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(digests):
        proofs, where, level = [""] * len(digests), list(range(len(digests))), digests
        while len(level) > 1:
            for j, at in enumerate(where):
                run = range(at // 16 * 16, min(at // 16 * 16 + 16, len(level)))
                proofs[j] += "".join(level[x] for x in run if x != at)
            where = [at // 16 for at in where]
            level = [H("".join(level[x : x + 16])) for x in range(0, len(level), 16)]
        return (level[0] if level else None), proofs

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in rows if r[1] == s) if rows else []
        own = [(k[2], r) for k, r in own]
        trees[s] = (own, *tree([k for k, _ in own]))
    root, top = tree([trees[s][1] for s in sources])
    return root, [(r[0], k, trees[s][1], p + above) for s, above in zip(sources, top) for (k, r), p in zip(trees[s][0], trees[s][2])]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, pos string, path binary, digest int, n long, part string, at string, row string, known string, name string"


def leaves(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", b"x", 2, 3, "q", "a", "r", "k", "n") for r in rows], SCHEMA)


def many(n, sources, rng):
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), t) for i, t in enumerate(rng.choices([*odd_texts(), "Ab C", "é"], k=n))]


@pytest.mark.parametrize("n, sources", [(0, ["a"]), (1, ["a"]), (16, ["a"]), (17, ["a"]), (300, ["a"]), (400, [None, "", "a", "a", "a", "a", "b", "ä", "Z", "😀", "ﬀ"]), (60, [f"s{i}" for i in range(40)])])
def test_manifest(spark, tmp_path, n, sources):
    rng = random.Random(n)
    rows = many(n, sources, rng)
    if n == 400:
        rows += [(None, "a", None, None, None), (None, "a", None, None, "x"), *rows[5:8], (3, "a", "en", 1, "same id")]
    rng.shuffle(rows)
    made = merkle.build(leaves(spark, rows), store=f"file://{tmp_path}/store")
    root, want = by_hand(rows)
    assert made.root == root
    got = merkle.audited(made).withColumn("proof", merkle.siblings(F.col("path"))).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.proof) for r in got) == Counter(want)
    assert all(r.verified and r.folded_root == root for r in got)


def test_tampering_is_found(spark):
    rows = many(200, ["a", "b"], random.Random(1))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    made = merkle.build(leaves(spark, rows), {"tampered": F.when(changed, merkle.leaf(lowered))})
    got = {r.doc_id: r.verified for r in merkle.audited(made, F.coalesce("tampered", "leaf")).collect()}
    want = {i: not (zlib.crc32(str(i).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in t or "")) for i, _, _, _, t in rows}
    assert got == want and set(want.values()) == {True, False}


# Alignment.


def by_bytes(rows):
    """Groups and links of every text, token by token."""
    v = alignment.Vocabularies(A, B)
    out = []
    for i, t in rows:
        data = (" " + (t or "")).encode()
        a = v.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = v.b.encode(t) if t else []
        if b"".join(v.bytes_a[x] for x in a) != data or b"".join(v.bytes_b[x] for x in b) != data:
            out.append((i, [], [], "", []))
            continue
        ends = lambda ids, of: [sum(map(len, map(of.__getitem__, ids[: k + 1]))) for k in range(len(ids))]
        at_a, at_b = ends(a, v.bytes_a), ends(b, v.bytes_b)
        both, groups, x, y = set(at_a) & set(at_b), [], 0, 0
        for end in sorted(both):
            to_x, to_y = at_a.index(end) + 1, at_b.index(end) + 1
            groups.append(",".join(map(str, a[x:to_x])) + "|" + ",".join(map(str, b[y:to_y])))
            x, y = to_x, to_y
        links = [(a[p], b[q]) for p, e in enumerate(at_a) for q, f in enumerate(at_b) if e == f]
        out.append((i, a, b, ";".join(groups), links))
    counts = Counter(x for r in out for x in r[4])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return {(i, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), g) for i, a, b, g, links in out}


ODD = ["▁ x", "a▁b ▁▁c", "\x00 a", " lead", "trail  ", "\n x", "a\n\n  b", "a \n b", "　wide　 x", "\x1c\x1f sep \x1c", "<s> a</s>", "it's  we'll", "  ", "ﬀ ½", "a b  c", "\r\n\t x", "xx" * 300, "日本語 テキスト", "😀😀 😀", "é é"]


def test_alignment(spark):
    rng = random.Random(5)
    rows = list(enumerate([*(t for t in odd_texts() if len(t or "") < 4000), *ODD, *(sentence(rng, 30) for _ in range(20)), "same words here again"])) + [(None, "no id")]
    found = alignment.with_link_counts(alignment.written(alignment.aligned(docs(spark, rows).repartition(3), A, B), "t"), A, B)
    got = {(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found.collect()}
    assert got == by_bytes(rows)
    assert {r[0] for r in got if r[1] == 0} >= {0, 1} and any(r[1] > 500 for r in got)


def test_alignment_of_blanks_at_the_end(spark):
    """A last blank is a token of both sides, also beside units that begin with several blanks."""
    rows = list(enumerate(["a ", "a\n ", " c", "   c", "x \n  ", " ", "the end ", "b  ", "漢字 "]))
    found = alignment.with_link_counts(alignment.written(alignment.aligned(docs(spark, rows).coalesce(1), A, B), "t"), A, B)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["groups"]) for r in found.collect()}
    v = alignment.Vocabularies(A, B)
    for i, text in rows:
        a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
        ends = [np.cumsum([len(of[t]) for t in ids]).tolist() for ids, of in ((a, v.bytes_a), (b, v.bytes_b))]
        both = [0, *sorted(set(ends[0]) & set(ends[1]))]
        side = lambda ids, end, lo, hi: ",".join(str(t) for t, e in zip(ids, end) if lo < e <= hi)
        groups = [side(a, ends[0], lo, hi) + "|" + side(b, ends[1], lo, hi) for lo, hi in zip(both, both[1:])]
        assert got[i] == (len(a), len(b), len(groups), ";".join(groups)), text


def test_alignment_forgets_and_splits(monkeypatch):
    texts = [sentence(random.Random(i), 40) for i in range(30)] + ["y" * 700 + " z"]
    whole = alignment.Aligner(A, B).align(texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "TOGETHER", 7)
    one = alignment.Aligner(A, B)
    assert [one.align([t])[0] for t in texts] == whole
    assert max(map(len, one.recent)) <= alignment.LONGEST


def test_units_equal_whole_texts():
    """The libraries give the same ids for a text and for its units."""
    rng = random.Random(9)
    v, one = alignment.Vocabularies(A, B), alignment.Aligner(A, B)
    signs = [" ", "  ", "\n", "\t", "a", "Be", "'s", "9", "ß", "中", "!", " ", "\x1c", "é", "…", " "]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(3000)]
    for t, (groups, _, n_a, n_b) in zip(texts, one.align(texts)):
        if groups:
            cut = [g.split("|") for g in groups.split(";")]
            assert ",".join(x for x, _ in cut) == ",".join(map(str, v.a.encode(" " + t, add_special_tokens=False).ids)), repr(t)
            assert ",".join(y for _, y in cut) == ",".join(map(str, v.b.encode(t))), repr(t)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        alignment.Vocabularies(public_tokenizers.path("word_bpe_49k.json"), B)


def test_alignment_of_nothing(spark):
    found = alignment.with_link_counts(alignment.written(alignment.aligned(docs(spark, []), A, B), "t"), A, B)
    assert found.count() == 0
