"""Small tables and brute-force rules for the operators' tests."""

from __future__ import annotations

import random
import re

import pytest

pytest.importorskip("tidemark.llm")

DOCS = "doc_id long, text string, lang string, score double, row string, reg binary, key long, n_shingles long"


def docs(spark, rows):
    """Documents, with further columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", None, "x", b"y", 1, 2) for i, t in rows], DOCS)


def words(text: str) -> list[str]:
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x20\x09-\x0d]+", lower)


def shingle_set(text: str | None, k: int = 5) -> set:
    w = words(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Null, empty, blank, short, accented, long, repeated and unspaced texts."""
    rng = random.Random(11)
    return [None, "", "   ", "\n\t", "one", "it's  we'll 're", "Ünï çødé — 中文字 😀 ½", "x" * 5000, " " * 700 + "a", sentence(rng, 3000), "same words here again", "same words here again", "1d10t l0ser i d i o t", "a b▁c<|endoftext|> z"]
