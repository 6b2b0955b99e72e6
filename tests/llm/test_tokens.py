"""Token counts, packing and SentencePiece against the libraries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tests.llm.helpers import docs, odd_texts, sentence

from tidemark.llm import packing, sentencepiece, token_counts
from tidemark.llm.queries import tokenizer


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    alphabet = list("abcdefgh's'tre ll  \n\t.,!123éßñ中文　 😀")
    noise = ["".join(rng.choices(alphabet, k=rng.randint(0, 1500))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*odd_texts(), *noise, sentence(rng, 900)])]
    return docs(spark, [*rows, (None, "no id"), rows[4]]).repartition(3), rows


def test_counts_equal_the_library(spark, table):
    from tokenizers import Tokenizer

    df, rows = table
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = token_counts.count_tokens(df, tokenizer("byte_bpe_50k.json"), limit=20).collect()
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_tokens"]) == want[r["doc_id"]]
        assert r["over_limit"] == (r["n_tokens"] > 20)


def test_chunks_without_synchronising_bytes(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = ["字" * 3000, "a" * 4000, "'" * 1700, " " * 1600 + "b", "é" * 900 + " x " + "中" * 800]
    machine = token_counts.transducer(tokenizer("byte_bpe_50k.json"))
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        assert machine.counts(data, np.array([0, len(data)])).tolist() == [len(library.encode(t, add_special_tokens=False).ids)]


def test_a_full_table_is_begun_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 40)
    machine = token_counts.Transducer(tokenizer("byte_bpe_50k.json"))
    data = np.frombuffer(b"some words that need states", np.uint8)
    first = machine.counts(data, np.array([0, len(data)])).tolist()
    assert machine.counts(data, np.array([0, len(data)])).tolist() == first


def test_pieces_equal_the_library(spark, table):
    from tokenizers import Tokenizer

    df, rows = table
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = packing.pack_documents(df.where("doc_id is not null"), tokenizer("word_bpe_49k.json"), capacity=64).distinct().collect()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want = {(n, a // 4, min(64, (len(ids) - a) // 4), zlib.crc32(ids[a : a + 256])) for n, a in enumerate(range(0, len(ids), 256))}
        assert {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i} == want


def test_sequences_are_gapless_and_few(spark, table):
    df, _ = table
    rows = packing.pack_documents(df, tokenizer("word_bpe_49k.json"), capacity=64).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 64) + 3


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = np.bincount(rng.integers(1, 101, rng.integers(1, 400)), minlength=101)
        used = np.zeros(101, int)
        for pattern, times in packing.plan(counts, 100):
            assert sum(pattern) <= 100 and times > 0
            for n in pattern:
                used[n] += times
        assert (used == counts).all()


def test_plan_finds_exact_complements():
    counts = np.zeros(101, int)
    counts[[60, 40, 70, 20, 10, 50]] = [2, 1, 1, 1, 1, 1]
    counts[5] = 2
    # 70 + 20 + 10, 60 + 40, and the rest beside 60 and 50.
    assert sum(t for _, t in packing.plan(counts, 100)) == 4
    assert ((70, 20, 10), 1) in packing.plan(counts, 100)


def test_sentencepiece_equals_the_library(spark, table):
    import sentencepiece as library

    df, rows = table
    model = library.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = sentencepiece.encoded(df, tokenizer("piece_bpe_32k.model"), with_ids=True).collect()
    assert len(got) == len(rows) + 2
    want = {i: model.encode(t or "") for i, t in rows}
    for r in got:
        assert r["round_trip"]
        if r["doc_id"] is not None:
            assert r["ids"] == want[r["doc_id"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_sentencepiece_long_words_blanks_and_decoding(spark):
    import random

    import sentencepiece as library

    rng = random.Random(5)
    texts = ["understanding" * 20, "a" * 300, "ab" * 70 + "中" * 20, "x" * 5000, "m² ²." * 9]
    texts += [" " * k + x for k in range(40) for x in ("", "a", "foo bar", " !")]
    texts += ["".join(rng.choice("abcdeinrst  ▁.,é中0_") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    path = tokenizer("piece_bpe_32k.model")
    model, vocabulary = library.SentencePieceProcessor(model_file=path), sentencepiece.Vocabulary(path)
    for r in sentencepiece.encoded(docs(spark, list(enumerate(texts))), path, with_ids=True).collect():
        assert r["ids"] == model.encode(texts[r["doc_id"]]), texts[r["doc_id"]][:50]
        assert r["round_trip"] and vocabulary.decode(r["ids"]) == texts[r["doc_id"]].replace("▁", " ")


def test_sentencepiece_cuts_plain_texts_in_arrow(monkeypatch):
    """Only texts with runs of blanks are cut by Python; both ways agree, and each distinct unit's words are looked for once."""
    import pyarrow as pa

    texts = ["a b", "", " a", "a ", "a  b", "é▁b\n c", "▁", "a b"]
    want, cut_by_hand = {i: sentencepiece.units_of(t) for i, t in enumerate(texts)}, []
    by_hand = sentencepiece.units_of
    monkeypatch.setattr(sentencepiece, "units_of", lambda t: cut_by_hand.append(t) or by_hand(t))
    at, counts, units = sentencepiece.units_in(pa.array(texts))
    cut = iter(units.to_pylist())
    assert {i: [next(cut) for _ in range(n)] for i, n in zip(at.to_pylist(), counts)} == want and sorted(cut_by_hand) == sorted(["", " a", "a  b", "▁"])
    found, (used,) = sentencepiece.distinct([units])
    words, places, counts = sentencepiece.words_of(found)
    assert found.take(used).to_pylist() == units.to_pylist() and words.to_pylist() == sorted(set(words.to_pylist()))
    parts = iter(words.take(pa.array(places)).to_pylist())
    assert ["".join(next(parts) for _ in range(n)) for n in counts] == ["▁" + u for u in found.to_pylist()]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert token_counts.count_tokens(none, tokenizer("byte_bpe_50k.json")).count() == 0
    assert packing.pack_documents(none, tokenizer("word_bpe_49k.json")).count() == 0
    assert sentencepiece.encoded(none, tokenizer("piece_bpe_32k.model")).count() == 0


def test_packing_of_another_tokenizer_file():
    """A file whose words the packing does not know goes to the library whole."""
    from tokenizers import Tokenizer

    from tidemark.llm.packing import Encoder, by_words

    word, byte = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")
    assert by_words(word) and not by_words(byte)
    texts = ["It's  a Test", "", "don't 123 über"]
    library = Tokenizer.from_file(byte)
    assert Encoder(byte).encode_all(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
