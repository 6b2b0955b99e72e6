"""Quality, toxicity, URL filters and archives: brute force, held-out accuracy, round trips."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import docs, odd_texts, sentence

from tidemark.llm import quality, toxicity, urls, warc
from tidemark.llm.queries import URL_RULES

SF = "/root/testdata/sf0.01"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# Quality.

def junk(rng):
    return " ".join(w.upper() + "!!" for w in sentence(rng, 40).split())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    rows = [(i, junk(rng) if i % 5 == 0 else sentence(rng, 60)) for i in range(200)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 200, 2)]
    return rows, docs(spark, rows).repartition(3), labelled(spark, labels)


def test_quality_parts_junk_from_text(corpus):
    rows, df, labels = corpus
    # Cold, so that the weights decide: at temperature 1 the models of so few words leave some of it to chance.
    got = {r["doc_id"]: r["sampled"] for r in quality.resampled(df, labels, temperature=0.05, k=160).collect()}
    assert got == {i: i % 5 != 0 for i, _ in rows}


def test_the_budget_is_the_share_of_good_labels(spark):
    labels = labelled(spark, [(i, int(i % 4 > 0), 0) for i in range(100)] + [(None, None, 1)])
    assert quality.good_share(labels) == pytest.approx(0.75 + 2 * (0.75 * 0.25 / 100) ** 0.5)
    assert quality.good_share(labelled(spark, [])) == 1.0
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.resampled(d, labels).collect()
    k = sum(r["sampled"] for r in got)
    assert k == math.ceil(len(got) * quality.good_share(labels))
    # The noise decides on some rows: the sample is not the k largest weights.
    threshold = sorted((r["log_weight"] for r in got), reverse=True)[k - 1]
    differ = sum(r["sampled"] != (r["log_weight"] >= threshold) for r in got)
    assert 0 < differ < 0.1 * len(got)
    # No row labelled good is left out.
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert all(r["sampled"] for r in got if r["doc_id"] in good)


def test_weights_against_a_plain_model(corpus):
    """Log weights by dictionaries of buckets, counted token by token."""
    rows, df, labels = corpus
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}

    def of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return Counter(quality.features(data, np.array([0, len(data)]))[0].tolist())

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw += of(t)
        target += of(t) if i in good else Counter()
    r = np.array([raw[b] + quality.PRIOR for b in range(quality.BUCKETS)])
    q = np.array([target[b] + quality.PRIOR for b in range(quality.BUCKETS)]) + quality.SHRINK * quality.BUCKETS * r / r.sum()
    ratio = np.log(q / q.sum()) - np.log(r / r.sum())
    got = {x["doc_id"]: x for x in quality.resampled(df, labels).collect()}
    for i, t in rows:
        assert got[i]["log_weight"] == pytest.approx(sum(n * ratio[b] for b, n in of(t).items()), abs=1e-6)
        assert got[i]["n_features"] == sum(of(t).values())


def test_features_are_unigrams_and_bigrams():
    text = "Ab, cd cd!"
    data = np.frombuffer(text.encode(), np.uint8)
    bucket, of = quality.features(data, np.array([0, len(data)]))
    assert len(bucket) == 5 + 4 and set(of) == {0}  # Ab | , | cd | cd | !


def test_the_sample_has_k_rows(corpus):
    rows, df, labels = corpus
    got = quality.resampled(df, labels, temperature=50.0, k=37).collect()
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    assert sum(r["sampled"] for r in got) == 37
    assert min(r["gumbel_key"] for r in got if r["sampled"]) == keys[36]


def test_kth_largest_with_ties(spark):
    values = [1.0] * 50 + [2.0] * 3 + [5.0, 1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 3, 5, 6, 40, len(values)):
        assert quality.kth_largest(df, "x", k) == order[k - 1]


def test_sample_is_the_k_largest_keys_with_gumbel_noise(spark):
    """A model without ratios leaves the noise: k of many equal documents, by a draw that NumPy's own agrees with."""
    df = docs(spark, [(i, "same text") for i in range(4000)])
    got = quality.resampled(df, labelled(spark, []), k=500).collect()
    keys = np.array([r["gumbel_key"] for r in got])
    assert {r["doc_id"] for r in got if r["sampled"]} == {got[i]["doc_id"] for i in np.argsort(-keys)[:500]}
    drawn = np.random.default_rng(1).gumbel(size=100_000)
    for share in (0.05, 0.25, 0.5, 0.75, 0.95):
        assert np.quantile(keys, share) == pytest.approx(np.quantile(drawn, share), abs=0.12)


def test_equal_keys_fall_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in (9, 4, 7, None)] + [(1, 2.0), (2, 0.5)], "doc_id long, gumbel_key double")
    for k, want in ((2, {1, None}), (3, {1, None, 4}), (4, {1, None, 4, 7}), (6, {1, None, 4, 7, 9, 2}), (0, set())):
        assert {r["doc_id"] for r in rows.where(quality._sampler(rows, k)(F.col("gumbel_key"))).collect()} == want


def test_quality_of_odd_rows(spark):
    df = docs(spark, [*enumerate(odd_texts()), (None, "no id"), (1, "")])
    none = labelled(spark, [])
    got = quality.resampled(df, none).collect()
    assert len(got) == len(odd_texts()) + 2 and all(r["sampled"] and r["log_weight"] == 0 for r in got)
    kept = quality.sampled_documents(df, labelled(spark, [(9, 1, 0), (None, 1, 0), (3, None, None)]))
    assert kept.columns == df.columns
    assert quality.resampled(docs(spark, []), none).count() == 0


# Toxicity.

def brute_restore(model, word):
    """The cheapest of all spellings, each scored whole."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", word)]
    ways = []
    for c, n in runs:
        if c.isalpha():
            ways.append([(c * k, toxicity.DROPPED * (n - k)) for k in ((1, 2) if n > 2 else (n,))])
        else:
            ways.append([(x * k, toxicity.SIGN * n) for x in toxicity.STANDS_FOR[c] for k in ((1, 2) if n > 2 else (n,))] + [(c * n, toxicity.KEPT * n)])
    best = (math.inf, "")

    def walk(i, text, cost):
        nonlocal best
        if i == len(ways):
            a = b = 0
            for x in text:
                j = ord(x) - 96 if x.isalpha() else 0
                cost -= model.log[a][b][j]
                a, b = b, j
            best = min(best, (cost - model.log[a][b][0], text))
            return
        for s, price in ways[i]:
            walk(i + 1, text + s, cost + price)

    walk(0, "", 0.0)
    return best[1]


@pytest.fixture(scope="module")
def char_model():
    text = ("idiot loser pathetic worthless the moon is bright and still this little boat sails on " * 20).encode()
    return toxicity.CharModel(toxicity.char_counts(np.frombuffer(text, np.uint8), np.array([0, len(text)])))


def test_trigram_counts_against_a_loop():
    texts = ["ab ba", "Abc1d", "", "é a", "z"]
    want = Counter()
    for t in texts:
        for w in re.findall(r"[a-z]+", t.lower()):
            s = [0, 0, *(ord(c) - 96 for c in w), 0]
            want.update(zip(s, s[1:], s[2:]))
    data = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = toxicity.char_counts(np.frombuffer(data, np.uint8), off).reshape(27, 27, 27)
    assert {k: got[k] for k in zip(*np.nonzero(got))} == dict(want)


@pytest.mark.parametrize("word", ["1d10t", "l0ser", "a55", "a$$", "b0000t", "looooser", "p4th3tic", "w0rthle55", "b04t", "7h15"])
def test_viterbi_against_all_spellings(char_model, word):
    assert char_model.restore(word) == brute_restore(char_model, word)


def test_disguises_are_undone(char_model):
    restorer = toxicity.Restorer(char_model)
    text = "you 1d10t and LOOOSER , i d i o t s.o.o.n clean words é stay 2024"
    data = np.frombuffer((text + "l0ser").encode(), np.uint8)
    cut = len(text.encode())
    new, off = restorer(data, np.array([0, cut, len(data)]))
    first, second = bytes(new[: off[1]]).decode(), bytes(new[off[1] :]).decode()
    assert first == "you idiot and loser , idiot soon clean words é stay 2024" and second == "loser"


def test_rows_of_letters_become_words():
    text = "you are an idiot and a pathetic loser but the moon is bright and this little boat sails on for you and an idiot " * 20
    data = np.frombuffer(text.encode(), np.uint8)
    off = np.array([0, len(data)])
    counts = toxicity.word_counts(data, off)
    some = np.flatnonzero(counts)
    restorer = toxicity.Restorer(toxicity.CharModel(toxicity.char_counts(data, off), toxicity.frequent_words(some, counts[some], counts.sum() // 2)))

    def restored(text):
        return bytes(restorer(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]).decode()

    assert restored("y o u i d i o t") == restored("y o u   i d i o t") == restored("y\no\nu\ni\nd\ni\no\nt") == "you idiot"
    assert restored("a i d i o t") == "a idiot"
    assert restored("y o u") == "you" and restored("l0$$") == "loss"
    assert restored("idio7") == restored("1d10t") == restored("id10+") == "idiot" and restored("you! 12") == "you! 12"
    spaced = "the moon is bright and this little boat sails on but you are an idiot and a pathetic loser"
    assert restored(" ".join(spaced.replace(" ", ""))) == spaced
    assert restored(" ".join((spaced.replace(" ", "") * 40))) == " ".join([spaced] * 40)
    assert restored("idi" + "o" * 300 + "t") == "idiot"


def test_toxicity_on_held_out_rows(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.scored(d, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    held = [(truth[i], got[i]["predicted"]) for i in truth if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    clean = [p for t, p in held if not t]
    assert sum(clean) / len(clean) < 0.05


def test_disguised_words_count(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 30) + (" snorkle bad" if i % 4 == 0 else " fine")) for i in range(300)]
    labels = labelled(spark, [(i, 1, int(i % 4 == 0)) for i in range(300)])
    new = [(1000, sentence(rng, 30) + " sn0rkle"), (1001, sentence(rng, 30) + " s n o r k l e"), (1002, sentence(rng, 30)), (1003, None), (1004, ""), (None, "x")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs(spark, rows + new), labels).collect()}
    assert [got[i] for i in (1000, 1001, 1002, 1003, 1004, None)] == [1, 1, 0, 0, 0, 0]
    df = docs(spark, rows + new)
    kept = toxicity.clean_documents(df, labels)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in got.items() if not p}


def test_toxicity_without_labels(spark):
    got = toxicity.scored(docs(spark, [(1, "a"), (2, None)]), labelled(spark, [])).collect()
    assert [r["predicted"] for r in got] == [0, 0]
    assert toxicity.scored(docs(spark, []), labelled(spark, [])).count() == 0


# URLs.

PAGES = "page_id long, url string, html string, words string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "w", "h") for i, u, h in rows], PAGES)


def by_hand(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_rules_and_parts(spark):
    found = ["http://a.example.net/en/1", "http://example.net/de/1?x=/en/", "https://EXAMPLE.com/de/x#y", "http://notexample.com/de/", "http://x.org/fr/a", "http://x.org/fr", "http://net", "http://net/", "x.org/fr/", None, "", "://", "a://b://c/d", "http://Ä.net/é?", "http://evil-net/"]
    got = urls.judged(pages(spark, [(i, u, "<p>example net words here</p>") for i, u in enumerate(found)]), URL_RULES).collect()
    assert len(got) == len(found)
    for r in got:
        host, path, rule, verdict = by_hand(found[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_words_are_split_by_likelihood(spark):
    text = "free music online " * 30 + "freem usic onli " + "casino games " * 20
    df = pages(spark, [(1, "http://freemusiconline.org/x", f"<b>{text}</b><script>freemusiconline</script>"), (2, "http://casinogames-24.com/", None), (3, f"http://{'q' * 80}.com/", "")])
    got = {r["page_id"]: r["words"] for r in urls.judged(df, URL_RULES).collect()}
    assert got[1] == ["free", "music", "online"]  # the labels that rules name are left out
    assert got[2] == ["casino", "games"]
    assert got[3] == ["q" * 80]


def test_scores_against_a_plain_naive_bayes(spark):
    rng = random.Random(4)
    some = ["news", "shop", "blog", "cats", "dogs", "bank"]
    found = []
    for i in range(300):
        name, path = "-".join(rng.choices(some, k=2)), "/".join(rng.choices(some, k=2))
        found.append(rng.choice([f"http://{name}.net/{path}", f"http://{name}.org/fr/{path}/{i}", f"http://{name}.info/{path}", f"http://www.info/{path}"]))
    df = pages(spark, [(i, u, "<p>" + " ".join(some) + "</p>") for i, u in enumerate(found)] + [(7, None, None), (None, found[0], "")])
    got = urls.judged(df, URL_RULES).collect()
    assert len(got) == 302
    features = lambda host, path: [f"host:{w}" for w in re.findall("[a-z]+", host) if w not in ("net", "example", "com", "org")] + [f"path:{'0' * len(w) if w.isdecimal() else w}" for w in re.findall("[a-z]+|[0-9]+", path) if w not in ("en", "de", "fr")]
    seen, kinds = {True: Counter(), False: Counter()}, Counter()
    for u in [*found, found[0]]:
        host, path, rule, verdict = by_hand(u)
        if rule:
            kinds[verdict == "block"] += 1
            seen[verdict == "block"].update(features(host, path))
    every = set(seen[True]) | set(seen[False])
    share = lambda w, kind: math.log((seen[kind][w] + 1) / (sum(seen[kind].values()) + len(every)))
    for r in got:
        want = math.log(kinds[True] / kinds[False]) + sum(share(w, True) - share(w, False) for w in features(r["host"], r["path"]) if w in every)
        assert r["log_odds"] == pytest.approx(want, abs=1e-5)
        assert r["rule"] or r["verdict"] == ("block" if want > 0 else "allow")


def test_viterbi_against_all_splits():
    counts = {"ab": 50, "abc": 3, "cd": 30, "d": 1, "bc": 8, "e": 1, "de": 20, "abcde": 1}
    total = sum(counts.values())

    def best(s):
        if not s:
            return 0.0
        return max([urls.UNKNOWN + best(s[1:])] + [math.log(n / total) + best(s[len(w) :]) for w, n in counts.items() if s.startswith(w)])

    for run in ("abcde", "abcd", "xabz", "deabbc", "zzz"):
        edges = [(i, w, n) for w, n in counts.items() for i in range(len(run)) if run.startswith(w, i)]
        words = urls.viterbi(run, edges, total)
        assert "".join(words) == run
        cost = sum(math.log(counts[w] / total) if w in counts else urls.UNKNOWN * len(w) for w in words)
        assert cost == pytest.approx(best(run))


def test_bayes_learns_from_rules(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        bad = i % 2 == 0
        rows.append((i, f"http://{rng.choice(['casino', 'poker']) if bad else rng.choice(['news', 'school'])}.{'net' if bad else 'example.net'}/{'' if bad else 'en/'}{i}", "<p>casino poker news school</p>"))
    rows += [(500, "http://pokercasino.xyz/a", ""), (501, "http://schoolnews.xyz/en/a", "")]
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages(spark, rows), URL_RULES).collect()}
    assert got[500] == "block" and got[501] == "allow"
    assert urls.judged(pages(spark, []), URL_RULES).count() == 0


# Archives.

def test_archives_come_back(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/ 9\r\nX: y", big), (3, None, other), (4, "u", "c" * 999), (5, "u", "c" * 999), (6, "u", None), (7, "u", ""), (None, "u", other), (None, "u", "alone" * 300), (9, "twice", big)]
    got = warc.read_archives(warc.write_archives(pages(spark, rows).repartition(3)), with_payload=True).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        first = max(same) if len(body) >= 1000 and same else i
        kind = "response" if first == i else "revisit"
        want.append((str(i), len(body), hashlib.sha1(body).hexdigest(), kind, str(first) if kind == "revisit" else "None"))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert all(r["payload"] is None if r["record_type"] == "revisit" else len(r["payload"]) == r["payload_bytes"] for r in got)
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0


def made(n=200):
    rng = random.Random(7)
    out = io.BytesIO()
    warc.archive((warc.record(i, f"http://x/{i}", sentence(rng, 300).encode(), None) for i in range(n)), out)
    return out.getvalue()


def test_the_dictionary_leads_and_is_used():
    import zstandard

    blob = made()
    magic, size = struct.unpack("<II", blob[:8])
    assert magic == warc.DICTIONARY_MAGIC and size > 0
    assert len(list(warc.decoded(io.BytesIO(blob)))) == 200
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(blob[8 + size :])


def test_archives_split_and_roll():
    out = io.BytesIO()
    n = warc.archive((warc.record(i, None, b"x" * 50, None) for i in range(1000)), out, size=20_000)
    assert warc.SAMPLES < n < 1000
    assert len(list(warc.decoded(io.BytesIO(out.getvalue())))) == n


def test_faults_are_found():
    blob = made(3)
    with pytest.raises(ValueError):
        list(warc.decoded(io.BytesIO(blob[:-5])))
    raw = warc.record(1, "http://x/", b"payload", None)
    assert warc.parsed(raw)["payload"] == b"payload"
    for bad in (raw[:-1], raw.replace(b"payload\r\n", b"paYload\r\n"), raw.replace(b"WARC/1.1", b"WARK/1.1"), raw.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_faults_name_the_archive(spark, tmp_path):
    import zstandard

    def read(blob):
        path = tmp_path / "x.warc.zst"
        path.write_bytes(blob)
        return warc.read_archives(spark.createDataFrame([(f"file://{path}", 1)], "path string, records long")).collect()

    good = warc.record(1, "http://x/", b"payload", None)
    assert read(zstandard.compress(good))[0]["page_id"] == 1
    without = b"\r\n".join(x for x in good.split(b"\r\n") if not x.lower().startswith(b"warc-type"))
    frame = bytearray(zstandard.compress(good))
    frame[-6] ^= 0xFF
    for blob in (zstandard.compress(without), bytes(frame), b"no frame at all"):
        with pytest.raises(Exception, match=r"x\.warc\.zst"):
            read(blob)
