"""Fingerprints, near-duplicates and exact search against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tests.llm.helpers import docs, odd_texts, sentence, shingle_set

from tidemark.llm import components, fingerprints, near_dedup, texthash, topk
from tidemark.llm.common import flat


def near_texts(rng: random.Random) -> list[str]:
    """Copies with one to many words changed, a chain of small edits, and unrelated texts."""
    out = []
    for _ in range(8):
        base = sentence(rng, rng.randint(60, 200)).split()
        for edits in (0, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            out.append(" ".join(w))
    chain = sentence(rng, 150).split()
    for i in range(12):
        out.append(" ".join(chain))
        chain[i * 12] = sentence(rng, 1)
    return out + [sentence(rng, rng.randint(1, 80)) for _ in range(40)]


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [4 << 20, 6000])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(9)
    texts = [*odd_texts(), *near_texts(rng)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(docs(spark, rows).repartition(4)).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text.upper()), (3, text.upper()), (None, text), (7, None), (8, "")]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(-1, 3, None, False), (3, 3, 3, True), (3, 3, 3, True), (5, 3, 3, False), (7, 0, 7, True), (8, 0, 8, True)]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_one_of_each_of_repeated_and_unnamed_rows(spark):
    rng = random.Random(8)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b + " more"), (None, c), (None, c), (None, None), (None, None), (None, ""), (4, c), (5, None), (5, None)]
    kept = near_dedup.one_of_each(docs(spark, rows))
    assert sorted(((r["doc_id"] or 0, r["text"] or "-") for r in kept.collect())) == sorted([(1, a), (3, b), (0, c), (0, "-"), (0, "-"), (4, c), (5, "-")])


def test_one_of_each_keeps_columns(spark):
    df = docs(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (4, None)])
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4]


def test_mixed_buckets_lose_no_link(spark):
    """Members that no star of a bucket links are found by the comparison of its blocks."""
    rng = random.Random(1)
    base = sentence(rng, 200).split()
    texts = []
    for group in range(6):
        own = list(base)
        for i in range(group * 9, group * 9 + 9):
            own[i * 3 % 200] = sentence(rng, 1)
        for _ in range(5):
            w = list(own)
            w[rng.randrange(200)] = sentence(rng, 1)
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    union = np.concatenate([a, rng.integers(0, 2**63, 300, dtype=np.uint64)])
    ra, ru = near_dedup.registers(a), near_dedup.registers(union)
    assert (near_dedup.merged(ra, near_dedup.registers(union[1500:])) == ru).all()
    got = near_dedup.estimate(np.array([1500]), np.array([1800]), np.array([(ra > ru).sum()]), np.array([(ra < ru).sum()]))
    assert got[0] == pytest.approx(1500 / 1800, abs=0.1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(links.where("a < 0")).count() == 0


def test_shingle_hashes_follow_the_words():
    texts = [t or "" for t in odd_texts()] + ["Same WORDS here again and more", "same words here again and more"]
    data, off = flat(__import__("pyarrow").array(texts))
    h, at = texthash.shingles(*texthash.words(data, off))
    for i, t in enumerate(texts):
        assert len(set(h[at[i] : at[i + 1]].tolist())) == len(shingle_set(t))
    assert set(h[at[-3] : at[-2]].tolist()) == set(h[at[-2] : at[-1]].tolist())


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = [*odd_texts(), *(sentence(rng, rng.randint(1, 900)) for _ in range(30))]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs(spark, rows).repartition(5)).collect()}
    prints = {}
    for n, (i, t) in enumerate(rows):
        t, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        changed = fingerprints.edited(t, after)
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        for name, other in (("near_edited", changed), ("near_next", after)):
            a, b = shingle_set(t), shingle_set(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert got[i][name] == pytest.approx(true, abs=0.0 if max(len(a), len(b)) <= 30 else 0.3)


def test_fingerprint_runs(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN_BYTES", 400)
    rng = random.Random(8)
    rows = [(rng.randrange(10**12), sentence(rng, 12)) for _ in range(60)] + [(None, "first of all"), (5, "twice a"), (5, "twice b")]
    got = fingerprints.fingerprint_edits(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1]))
    want = sorted(hashlib.sha256(fingerprints.edited(t, order[(n + 1) % len(order)][1]).encode()).hexdigest() for n, (_, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in got) == want
    one = fingerprints.fingerprint_edits(docs(spark, [(1, "only one here")])).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint_edits(docs(spark, [])).count() == 0


def test_sketches_merge_and_contain():
    rng = np.random.default_rng(6)
    large, small = rng.integers(0, 2**64, 20000, dtype=np.uint64), rng.integers(0, 2**64, 5, dtype=np.uint64)
    part = large[:2000]
    a, b = fingerprints.sketch(large), fingerprints.sketch(part)
    assert fingerprints.containment(b, a) == 1.0
    assert fingerprints.likeness(a, b) == pytest.approx(0.1, abs=0.03)
    both = fingerprints.merged(a, fingerprints.sketch(small))
    assert both[1] == min(a[1], fingerprints.WHOLE) and len(both[0]) >= len(a[0])
    again = fingerprints.from_text(fingerprints.to_text(a))
    assert (again[0] == a[0]).all() and again[1] == a[1]


def brute_top(rows, k):
    usable = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-(int(q @ v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_exact_search(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(12)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=40) * spread]) for i in range(230)]
    rows += [(300 + i, rows[50][1]) for i in range(20)]  # ties
    rows += [(400, None), (401, [None, 1.0]), (450, [float("nan")] * 40), (500, [1.0, 2.0]), (501, [3.0, 1.0]), (550, []), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<float>, ids string, n long").repartition(3)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=5).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 5)
    assert len(got) == len(brute_top(rows, 5))


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0
