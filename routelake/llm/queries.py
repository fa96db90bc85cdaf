"""Registered queries of the training-data operators: thin queries over whole tables, and their DuckDB SQL where SQL
can express the result."""

from __future__ import annotations

import functools
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from routelake.llm import (alignment, ball_tree, byte_bpe, conversations, decontaminate, language, license_scan, near_dup, pitman_yor, quality, token_counts,
                           token_store, url_filter)
from routelake.llm.common import table, written
from routelake.session import scratch_path, ship_package

#: Parameters of the registered queries: the vocabulary files they read.
BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prepared(query):
    """Makes the package importable on the executors before the query runs."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def bucket(of: int):
    """crc32 of doc_id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string")) % of


#: The rules of op1.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.parse_rules(spark, URL_RULES))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(token_counts.count_tokens(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN, "byte_bpe_50k"), "counts")
    return token_counts.maintain(counts, token_counts.Rollup(spark, scratch_path(spark, f"llm-rollup-{uuid.uuid4().hex}")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(bucket(5) != 0).where("lang is not null"), PIECES)
    return (language.classify(docs.select("doc_id", "text"), model, keep=["doc_id"])
            .withColumn("held_out", F.coalesce(bucket(5) == 0, F.lit(True)))
            .select("doc_id", "held_out", "lang_pred", "score"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write_tokens(table(spark, sf_dir, "documents"), BPE_JSON, end_id=2)

    def digest(doc_id, start, ids) -> dict:
        return {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}

    return token_store.read_tokens(files, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"), bucket(7) == 2)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"), BPE_JSON, PIECES)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs.where(bucket(3) != 1), labels.where(bucket(3) != 1))
    return (quality.classify(docs.select("doc_id", "text"), model, keep=["doc_id"])
            .withColumn("held_out", F.coalesce(bucket(3) == 1, F.lit(False))).select("doc_id", "held_out", "score", "predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: prepared(f) for f in (
    op1_url_filter, op2_near_dup, op3_license_scan, op4_token_counts, op5_language_id, op6_token_store, op7_byte_bpe, op8_lm_score, op9_top_k, op10_decontaminate,
    op11_token_alignment, op12_conversation_repair, op13_quality, pipeline)}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_OP1 = f"""
WITH p AS (
  SELECT page_id, coalesce({_LOW.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(v, h, s) AS (VALUES {_values((v, k.split("/")[0], "/" + k.partition("/")[2]) for v, k in URL_RULES)}),
f AS (
  SELECT page_id, h || s AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC, v DESC) AS n
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND n = 1
"""

_OP2 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS x FROM w),
n AS (SELECT w.doc_id, count(x) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(c) AS component_id, min(c) = n.doc_id AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id
"""

_OP3 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
t(base, id, label, j, w, key, need, n) AS (VALUES {_values(
    [(1, i, label, j, w, 1, len(p.split()), len(p.split())) for i, (label, p) in enumerate(license_scan.PHRASES) for j, w in enumerate(p.split())]
    + [(0, i, t.label, j, w, int(0 <= j - t.key_at < len(t.key.split())), len(t.key.split()), len(t.words))
       for i, t in enumerate(license_scan.TEMPLATES) for j, w in enumerate(t.words)])}),
m AS (
  SELECT doc_id, base, label, i - j AS pos, count(*) / any_value(n) AS share
  FROM p JOIN t ON p.w = t.w GROUP BY doc_id, base, id, label, i - j
  HAVING sum(key) = any_value(need) AND count(*) >= {license_scan.MIN_SHARE} * any_value(n))
SELECT w.doc_id, any_value(len(w.w)) AS n_words, count(*) FILTER (WHERE base = 1) AS n_base, min(pos) FILTER (WHERE base = 1) AS first_word,
       max(pos) FILTER (WHERE base = 1) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base = 1), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM w LEFT JOIN m ON m.doc_id = w.doc_id GROUP BY w.doc_id
"""

_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op1_url_filter": _OP1, "op2_near_dup": _OP2, "op3_license_scan": _OP3, "op9_top_k": _OP9}
