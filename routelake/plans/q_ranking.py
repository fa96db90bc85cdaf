"""Registered queries: sampling, slicing, windows, ranking metrics, pass@k."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelake.functions.numeric import as_double
from routelake.operators import ranking as R
from routelake.operators.common import r6
from routelake.plans import fixtures as fx
from routelake.plans.fixtures_sql import R6, with_
from routelake.plans.registry import register

# Arithmetic order keys (same value in Spark and DuckDB) for seeded sampling.
SEED = 42


def _log_key():
    return (F.col("query_id") * 7919 + F.col("llm_idx") * 104729 + SEED) % 1000003


_LOG_KEY_SQL = f"(query_id * 7919 + llm_idx * 104729 + {SEED}) % 1000003"


@register("m1_sample_per_task", with_("flog") + f"""
SELECT task_name, query_id, llm FROM (
  SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY {_LOG_KEY_SQL}, query_id, llm) AS rn FROM flog) t
WHERE rn <= 100""")
def m1_sample_per_task(spark, sf_dir):
    f = fx.f_log(spark, sf_dir)
    return R.top_n_per_group(f, "task_name", [_log_key(), "query_id", "llm"], 100).select("task_name", "query_id", "llm")


@register("m2_stratified_sample", with_("ftxt") + """
SELECT lang, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919 + 42) % 1009, doc_id) AS rn FROM ftxt) t
WHERE rn <= 100 // 4 + 1""")
def m2_stratified_sample(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    order = [(F.col("doc_id") * 7919 + SEED) % 1009, "doc_id"]
    return R.stratified_sample(d, "lang", 100, 4, order).select("lang", "doc_id")


@register("m3_slice_range", """
SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) t
WHERE rn > 10 AND rn <= 510""")
def m3_slice_range(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return R.slice_sorted(p, "p_partkey", 10, 510, "p_partkey")


@register("m3_slice_tail", """
SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) t
WHERE rn > 114""")
def m3_slice_tail(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return R.slice_sorted(p, "p_partkey", 114, None, "p_partkey")


@register("m4_head_per_source", """
SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) t
WHERE rn <= 5""")
def m4_head_per_source(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    return R.top_n_per_group(d, "source", ["doc_id"], 5).select("source", "doc_id")


@register("m5_sample_k_per_group", """
SELECT lang, source, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY (doc_id * 104729 + 7) % 1000003, doc_id) AS rn FROM documents) t
WHERE rn <= 3""")
def m5_sample_k_per_group(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    order = [(F.col("doc_id") * 104729 + 7) % 1000003, "doc_id"]
    return R.top_n_per_group(d, ["lang", "source"], order, 3).select("lang", "source", "doc_id")


@register("m6_first_k_queries", with_("flog") + """
SELECT task_name, query, llm, query_id FROM flog
WHERE (task_name, query) IN (
  SELECT task_name, query FROM (
    SELECT task_name, query, row_number() OVER (PARTITION BY task_name ORDER BY query) AS rn
    FROM (SELECT DISTINCT task_name, query FROM flog) d) t WHERE rn <= 3)""")
def m6_first_k_queries(spark, sf_dir):
    f = fx.f_log(spark, sf_dir)
    return R.first_k_keys_per_group(f, "task_name", "query", 3).select("task_name", "query", "llm", "query_id")


@register("m7_ratio_split", with_("flog") + """
SELECT f.query_id, f.llm, k.split_role FROM flog f JOIN (
  SELECT task_name, query_id,
    CASE WHEN r < floor(q * 0.7::DOUBLE) THEN 'train'
         WHEN r < floor(q * 0.7::DOUBLE) + floor(q * 0.1::DOUBLE) THEN 'validate'
         WHEN r < floor(q * 0.7::DOUBLE) + floor(q * 0.1::DOUBLE) + floor(q * 0.15::DOUBLE) THEN 'test' ELSE 'none' END AS split_role
  FROM (SELECT task_name, query_id, row_number() OVER (PARTITION BY task_name ORDER BY query_id) - 1 AS r,
               count(*) OVER (PARTITION BY task_name) AS q
        FROM (SELECT DISTINCT task_name, query_id FROM flog) d) t) k
ON f.task_name = k.task_name AND f.query_id = k.query_id""")
def m7_ratio_split(spark, sf_dir):
    f = fx.f_log(spark, sf_dir)
    return R.ratio_split(f, "task_name", "query_id", (0.7, 0.1, 0.15)).select("query_id", "llm", "split_role")


@register("m8_seeded_shuffle", """
SELECT vec_id, row_number() OVER (ORDER BY md5('1234:' || CAST(vec_id AS VARCHAR)), vec_id) AS position FROM embeddings""")
def m8_seeded_shuffle(spark, sf_dir):
    v = fx.table(spark, sf_dir, "embeddings").select("vec_id")
    return R.seeded_shuffle(v, 1234, "vec_id", position="position")


_MASK_DRAW_SQL = "((query_id * 31 + llm_idx * 17 + CAST(is_think AS INTEGER) * 7 + 1) % 1000) / 1000.0"


@register("m9_random_mask", with_("fgrid") + f"""
SELECT query_id, llm, {_MASK_DRAW_SQL} < 0.5 AS hidden FROM fgrid""")
def m9_random_mask(spark, sf_dir):
    g = fx.f_grid(spark, sf_dir)
    draw = ((F.col("query_id") * 31 + F.col("llm_idx") * 17 + F.col("is_think").cast("int") * 7 + 1) % 1000) / F.lit(1000.0)
    return R.random_mask(g, 0.5, 1, ["query_id", "llm"], draw=draw).select("query_id", "llm", "hidden")


@register("w2_chunk_positional", with_("flog") + """
SELECT split, chunk, count(*) AS n_rows, min(query_id) AS first_query, max(query_id) AS last_query FROM (
  SELECT split, query_id, (row_number() OVER (PARTITION BY split ORDER BY query_id, pos) - 1) // 40 AS chunk FROM flog) t
GROUP BY split, chunk""")
def w2_chunk_positional(spark, sf_dir):
    f = fx.f_log(spark, sf_dir)
    c = R.chunk_by_position(f, 40, "split", "query_id", "pos")
    return c.groupBy("split", "chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.min("query_id").alias("first_query"),
                                           F.max("query_id").alias("last_query"))


@register("w2_chunk_complete_only", with_("flog") + """
SELECT split, chunk, count(*) AS n_rows FROM (
  SELECT split, (row_number() OVER (PARTITION BY split ORDER BY query_id, pos) - 1) // 40 AS chunk,
         count(*) OVER (PARTITION BY split) AS total FROM flog) t
WHERE chunk < total // 40 GROUP BY split, chunk""")
def w2_chunk_complete_only(spark, sf_dir):
    f = fx.f_log(spark, sf_dir)
    c = R.chunk_by_position(f, 40, "split", "query_id", "pos", keep_partial=False)
    return c.groupBy("split", "chunk").agg(F.count(F.lit(1)).alias("n_rows"))


@register("w4_first_per_query", with_("flog") + """
SELECT query_id, llm, response FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM flog) t
WHERE rn = 1""")
def w4_first_per_query(spark, sf_dir):
    return R.first_per_group(fx.f_log(spark, sf_dir), "query_id", "pos").select("query_id", "llm", "response")


@register("w5_two_stage_topn", with_("flog") + """
SELECT query_id, llm, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY llm_judge DESC NULLS LAST, cost ASC NULLS LAST, s1) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY performance DESC NULLS LAST, cost ASC NULLS LAST, pos) AS s1
    FROM flog) a WHERE s1 <= 5) b
WHERE rank <= 2""")
def w5_two_stage_topn(spark, sf_dir):
    return R.two_stage_top(fx.f_log(spark, sf_dir), "query_id", 2).select("query_id", "llm", "rank")


def _sft_cols(f):
    return (f.withColumn("performance_processed", as_double(f, "performance"))
             .withColumn("llm_judge_processed", as_double(f, "llm_judge"))
             .withColumn("output_tokens_num_processed", F.col("output_tokens_num").cast("double")))


@register("w6_setting_sort", with_("flog") + """
SELECT s.setting, query_id, llm, CAST(row_number() OVER (PARTITION BY s.setting, query_id ORDER BY
    CASE WHEN s.setting = 'judge' THEN llm_judge ELSE performance END DESC NULLS LAST,
    CASE WHEN s.setting = 'hybrid' THEN llm_judge ELSE CAST(output_tokens_num AS DOUBLE) END DESC NULLS LAST, pos) AS INTEGER) AS rank
FROM flog, (VALUES ('perf'), ('judge'), ('hybrid')) s(setting)""")
def w6_setting_sort(spark, sf_dir):
    f = _sft_cols(fx.f_log(spark, sf_dir))
    return R.rank_settings(f, "query_id", ("perf", "judge", "hybrid")).select("setting", "query_id", "llm", "rank")


@register("w7_take_while_topk", with_("flog") + """
SELECT query_id, llm, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER w AS rank,
         sum(CASE WHEN performance = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped
  FROM flog WINDOW w AS (PARTITION BY query_id ORDER BY performance DESC NULLS LAST, CAST(output_tokens_num AS DOUBLE) DESC NULLS LAST, pos)) t
WHERE stopped = 0 AND rank <= 5""")
def w7_take_while_topk(spark, sf_dir):
    f = _sft_cols(fx.f_log(spark, sf_dir))
    return R.take_while_top_k(f, "query_id", R.setting_order("perf"), 5).select("query_id", "llm", "rank")


@register("w8_rank_models", with_("fgrid") + """
SELECT query_id, llm, CAST(row_number() OVER (PARTITION BY query_id ORDER BY performance DESC, pos) AS INTEGER) AS rank FROM fgrid""")
def w8_rank_models(spark, sf_dir):
    g = fx.f_grid(spark, sf_dir)
    return R.rank_within(g, "query_id", [F.col("performance").desc(), F.col("pos")]).select("query_id", "llm", "rank")


_REL_SQL = "CASE WHEN performance >= 0.06 THEN 1 ELSE 0 END"
_METRICS_SQL = with_("flog", extra={"x": f"""
SELECT query_id, {_REL_SQL} AS rel,
       row_number() OVER (PARTITION BY query_id ORDER BY -cost DESC NULLS LAST, pos) AS r,
       row_number() OVER (PARTITION BY query_id ORDER BY {_REL_SQL} DESC NULLS LAST, pos) AS i
FROM flog""", "m": """
SELECT query_id,
  CASE WHEN sum(CASE WHEN i <= 10 THEN rel / log2(i + 1.0) END) > 0
       THEN sum(CASE WHEN r <= 10 THEN rel / log2(r + 1.0) END) / sum(CASE WHEN i <= 10 THEN rel / log2(i + 1.0) END)
       ELSE 0.0 END AS ndcg_at_k,
  max(CASE WHEN r <= 10 AND rel > 0 THEN 1 ELSE 0 END)::DOUBLE AS hit_at_k,
  coalesce(1.0 / min(CASE WHEN rel = 1 THEN r END), 0.0) AS mrr
FROM x GROUP BY query_id"""})


def _metrics(spark, sf_dir, k=10):
    f = fx.f_log(spark, sf_dir).withColumn("pred", -F.col("cost")).withColumn(
        "rel", F.when(F.col("performance") >= 0.06, 1).otherwise(0))
    return R.ranking_metrics(f, "query_id", "pred", "rel", k)


@register("w9_w11_ranking_metrics", _METRICS_SQL + f"""
SELECT query_id, {R6('ndcg_at_k')} AS ndcg_at_k, hit_at_k, {R6('mrr')} AS mrr FROM m""")
def w9_w11_ranking_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select("query_id", r6("ndcg_at_k").alias("ndcg_at_k"), "hit_at_k", r6("mrr").alias("mrr"))


@register("w10_hit_at_1", _METRICS_SQL.replace("<= 10", "<= 1") + f"""
SELECT query_id, {R6('ndcg_at_k')} AS ndcg_at_k, hit_at_k FROM m""")
def w10_hit_at_1(spark, sf_dir):
    """W9/W10 at the first place: hits and misses."""
    m = _metrics(spark, sf_dir, 1)
    return m.select("query_id", r6("ndcg_at_k").alias("ndcg_at_k"), "hit_at_k")


@register("g4_metric_means", _METRICS_SQL + f"""
SELECT metric, {R6('value')} AS value FROM (
  SELECT 'ndcg_at_k' AS metric, avg(ndcg_at_k) AS value FROM m
  UNION ALL SELECT 'hit_at_k', avg(hit_at_k) FROM m
  UNION ALL SELECT 'mrr', avg(mrr) FROM m) t""")
def g4_metric_means(spark, sf_dir):
    from routelake.operators.scoring import metric_means
    m = metric_means(_metrics(spark, sf_dir), exclude=["query_id"])
    return m.select("metric", r6("value").alias("value"))


@register("w12_one_hot_argmax", with_("fgrid") + """
SELECT query_id, llm, CAST(row_number() OVER (PARTITION BY query_id ORDER BY performance DESC NULLS LAST, pos) = 1 AS INTEGER) AS label
FROM fgrid""")
def w12_one_hot_argmax(spark, sf_dir):
    return R.one_hot_argmax(fx.f_grid(spark, sf_dir), "query_id", "performance").select("query_id", "llm", "label")


@register("w13_attempt_ids", with_("fcode") + """
SELECT task_id, l_orderkey, l_linenumber,
       row_number() OVER (PARTITION BY task_id ORDER BY l_orderkey, l_linenumber) - 1 AS completion_id FROM fcode""")
def w13_attempt_ids(spark, sf_dir):
    c = fx.f_code(spark, sf_dir)
    return R.attempt_ids(c, "task_id", ["l_orderkey", "l_linenumber"]).select("task_id", "l_orderkey", "l_linenumber", "completion_id")


@register("w14_resume_point", """
SELECT min(CASE WHEN event_type = 'error' THEN event_id END) AS resume_idx FROM events""")
def w14_resume_point(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("judge"))
    return R.resume_point(e, "event_id", "judge")


@register("w15_sink_order", with_("fgrid") + "SELECT query_id, llm, performance FROM fgrid")
def w15_sink_order(spark, sf_dir):
    return R.sink_order(fx.f_grid(spark, sf_dir).select("query_id", "llm", "performance"), ["query_id", "llm"])


@register("g5_pass_at_k", with_("fcode", extra={"per": """
SELECT task_id, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM fcode GROUP BY task_id""", "est": """
SELECT k, n, CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0
       ELSE 1.0 - (SELECT product(1.0 - k / i::DOUBLE) FROM range(n - c + 1, n + 1) r(i)) END AS p
FROM per, (VALUES (1), (5), (10)) ks(k)"""}) + f"""
SELECT 'pass@' || CAST(k AS VARCHAR) AS metric, {R6('avg(p)')} AS pass_at_k FROM est GROUP BY k HAVING min(n) >= k""")
def g5_pass_at_k(spark, sf_dir):
    p = R.pass_at_k(fx.f_code(spark, sf_dir), ks=(1, 5, 10))
    return p.select("metric", r6("pass_at_k").alias("pass_at_k"))


@register("g6_completeness", with_("fcode") + """
SELECT count(*) AS missing_problems FROM part WHERE p_partkey NOT IN (SELECT task_id FROM fcode)""")
def g6_completeness(spark, sf_dir):
    problems = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"))
    return R.completeness(problems, fx.f_code(spark, sf_dir))


@register("u1_union_splits", with_("flog") + """
SELECT split, count(*) AS n_rows FROM (SELECT split FROM flog WHERE split = 'train' UNION ALL SELECT split FROM flog WHERE split = 'test') t
GROUP BY split""")
def u1_union_splits(spark, sf_dir):
    f = fx.f_log(spark, sf_dir)
    u = R.union_all(f.where(F.col("split") == "train"), f.where(F.col("split") == "test"))
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("u4_distinct_values", with_("flog") + "SELECT DISTINCT task_name, llm FROM flog")
def u4_distinct_values(spark, sf_dir):
    return R.distinct_values(fx.f_log(spark, sf_dir), ["task_name", "llm"])


@register("g9_distinct_models", with_("flog") + """
SELECT string_agg(llm, ',' ORDER BY llm) AS models FROM (SELECT DISTINCT llm FROM flog) t""")
def g9_distinct_models(spark, sf_dir):
    m = R.distinct_sorted_list(fx.f_log(spark, sf_dir), "llm")
    return m.select(F.array_join("models", ",").alias("models"))
