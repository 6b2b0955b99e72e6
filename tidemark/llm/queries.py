"""The registered queries of the operators, under the names of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


QUERIES["op8_token_counts"] = op8_token_counts


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES["op5_fingerprints"] = op5_fingerprints


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op7_near_dedup"] = op7_near_dedup


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op3_quality_resampling"] = op3_quality_resampling


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op4_toxicity"] = op4_toxicity


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES["op6_packing"] = op6_packing


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages")))


QUERIES["op9_warc"] = op9_warc
#: On whole tables; SHA-1 comes from DuckDB's own function.
ORACLES["op9_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as payload_bytes, sha1(body) as payload_digest, max(page_id) over (partition by body) as largest from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> largest then largest end as refers_to
from d
"""


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


QUERIES["op2_exact_topk"] = op2_exact_topk
ORACLES["op2_exact_topk"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""

#: The rules of op1's contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.urls import judged

    return judged(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES["op1_url_filters"] = op1_url_filters


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sentencepiece import encoded

    return encoded(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


QUERIES["op10_sentencepiece"] = op10_sentencepiece


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidemark.llm.merkle import audited, build, leaf, sha, siblings

    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    manifest = build(docs, {"tampered": F.when(changed, leaf(lowered))})
    found = audited(manifest, F.coalesce("tampered", "leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", sha(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", "verified")


QUERIES["op11_merkle_manifest"] = op11_merkle_manifest

#: Levels written out in the twin of op11: enough for 16 ** 8 leaves a source, and as many sources.
_LEVELS = 8


def _merkle_sql() -> str:
    """Levels one by one: nodes ``n``, their runs ``r``, and each document's place, proof and digest so far, ``d``; a tree of one node stays as it is."""

    def part(value: str) -> str:
        return f"coalesce(strlen({value})::varchar || ':' || {value}, '-')"

    def levels(kind: str) -> list[str]:
        out = []
        for k in range(_LEVELS):
            out.append(f"{kind}r{k} as (select tree, n, pos // 16 as run, list(digest order by pos) as kids from {kind}n{k} group by all)")
            out.append(f"{kind}n{k + 1} as (select tree, run as pos, case when n = 1 then 1 else (n + 15) // 16 end as n, case when n = 1 then kids[1] else sha256(array_to_string(kids, '')) end as digest from {kind}r{k})")
            before, after = "array_to_string(kids[1:pos % 16], '')", "array_to_string(kids[pos % 16 + 2:], '')"
            out.append(
                f"{kind}d{k + 1} as (select d.* exclude (pos, proof, folded), pos // 16 as pos, proof || {before} || {after} as proof, "
                f"case when n = 1 then folded else sha256({before} || folded || {after}) end as folded from {kind}d{k} d join {kind}r{k} r on d.tree = r.tree and d.pos // 16 = r.run)"
            )
        return out

    fixed = [part(f"{c}::varchar") for c in ("doc_id", "source", "lang", "n_chars")]
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ord(substr(doc_id::varchar, i, 1))::bigint), lambda c, b: {bits}), 4294967295)"
    lowered = "case when " + crc + " % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end"
    steps = [
        f"l as (select doc_id, coalesce('s' || source, '') as tree, sha256({' || '.join([*fixed, part('text')])}) as leaf, sha256({' || '.join([*fixed, part(f'({lowered})')])}) as folded from documents)",
        "sd0 as (select doc_id, tree, leaf, folded, '' as proof, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from l)",
        "sn0 as (select tree, pos, count(*) over (partition by tree) as n, leaf as digest from sd0)",
        *levels("s"),
        f"roots as (select tree, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from sn{_LEVELS})",
        "tn0 as (select 0 as tree, pos, n, digest from roots)",
        f"td0 as (select d.doc_id, d.leaf, r.digest as subroot, d.proof, d.folded, 0 as tree, r.pos from sd{_LEVELS} d join roots r on d.tree = r.tree)",
        *levels("t"),
    ]
    chosen = "doc_id, leaf, subroot, n.digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = n.digest as verified"
    return f"with {', '.join(steps)} select {chosen} from td{_LEVELS} d join tn{_LEVELS} n on d.tree = n.tree"


ORACLES["op11_merkle_manifest"] = _merkle_sql()


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES["op12_exact_dedup"] = op12_exact_dedup
ORACLES["op12_exact_dedup"] = """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(text) as text_sha256
from d window same as (partition by text)
"""


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidemark.llm.alignment import aligned, with_link_counts
    from tidemark.llm.common import written

    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    found = aligned(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))
    return with_link_counts(written(found.withColumn("groups_sha256", digest).drop("groups"), "alignments"), *paths)


QUERIES["op13_tokenizer_alignment"] = op13_tokenizer_alignment
