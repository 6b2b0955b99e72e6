"""The pipeline's stages against what they are made of."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tests.llm.test_similarity import brute_components

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from tidemark.llm import quality, toxicity  # noqa: E402
from tidemark.llm.queries import tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    from tokenizers import Tokenizer

    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "packing"]
    kept = d
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, SF).cache()
        assert after.columns == d.columns
        ids = sorted(r["doc_id"] for r in after.collect())
        if name == "quality":
            want = [r["doc_id"] for r in quality.resampled(kept, labels).collect() if r["sampled"]]
        elif name == "toxicity":
            want = [r["doc_id"] for r in toxicity.scored(kept, labels).collect() if not r["predicted"]]
        else:
            want = [i for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in kept.collect()]).items() if i == c]
        assert ids == sorted(want)
        assert len(ids) > 0.5 * kept.count()
        kept = after
    rows = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in kept.collect()}
    assert {r["doc_id"] for r in rows} == set(texts)
    for i, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        want = {(n, zlib.crc32(ids[a : a + 8192])) for n, a in enumerate(range(0, len(ids), 8192))}
        assert {(r["piece"], r["ids_crc32"]) for r in rows if r["doc_id"] == i} == want


def test_the_pipeline_takes_empty_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
