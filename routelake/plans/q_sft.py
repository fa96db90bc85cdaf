"""Registered queries: fine-tuning set export."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelake.operators import sft
from routelake.plans import fixtures as fx
from routelake.plans.fixtures_sql import with_
from routelake.plans.registry import register

_INSTR = "'Answer the following questions as required.'"
_GT_OUT = """CASE WHEN task_name IN ('mbpp', 'human_eval') THEN '[BEGIN]' || chr(10) || ' ' || ground_truth || ' ' || chr(10) || '[DONE]'
  WHEN task_name IN ('mmlu','gpqa','commonsense_qa','openbook_qa','arc_challenge','hellaswag') THEN '(' || ground_truth || ')'
  ELSE ground_truth END"""
_INPUT = "replace(replace(query, 'let''s think step by step', ''), 'Let''s think step by step', '')"


def _ordered(setting: str, src: str = "flog") -> str:
    first = "llm_judge" if setting == "judge" else "performance"
    second = "llm_judge" if setting == "hybrid" else "CAST(output_tokens_num AS DOUBLE)"
    return f"""SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank,
  sum(CASE WHEN performance = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped
FROM {src} WINDOW w AS (PARTITION BY query_id ORDER BY {first} DESC NULLS LAST, {second} DESC NULLS LAST, pos)"""


def _train_sql(setting: str, k: int, src: str = "flog", extra: dict | None = None) -> str:
    ctes = dict(extra or {})
    ctes["o"] = _ordered(setting, src)
    return with_("flog", extra=ctes) + f"""
SELECT query_id, 0 AS seq, {_INSTR} AS instruction, {_INPUT} AS input, {_GT_OUT} AS output FROM o WHERE rank = 1
UNION ALL
SELECT query_id, rank AS seq, {_INSTR}, query, response FROM o WHERE stopped = 0 AND rank <= {k}"""


@register("e12_sft_train_perf", _train_sql("perf", 5))
def e12_sft_train_perf(spark, sf_dir):
    return sft.sft_train_set(fx.f_log(spark, sf_dir), "perf", 5)


@register("e12_sft_train_judge", _train_sql("judge", 3))
def e12_sft_train_judge(spark, sf_dir):
    return sft.sft_train_set(fx.f_log(spark, sf_dir), "judge", 3)


@register("e12_sft_train_hybrid_small", _train_sql("hybrid", 5, "fs", {"fs": """
SELECT * FROM flog WHERE llm IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0
                                 UNION ALL SELECT n_name || '_think' FROM nation WHERE n_nationkey % 3 = 0)"""}))
def e12_sft_train_hybrid_small(spark, sf_dir):
    small = fx.table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 3 == 0).select(F.col("n_name").alias("llm"))
    return sft.sft_train_set(fx.f_log(spark, sf_dir), "hybrid", 5, small_models=small)


@register("p9_sft_baseline_replicated", with_("flog", extra={"o": _ordered("baseline")}) + f"""
SELECT query_id, 0 AS seq, {_INSTR} AS instruction, {_INPUT} AS input, {_GT_OUT} AS output, CAST(c.copy AS INTEGER) AS copy
FROM o, range(0, 3) c(copy) WHERE rank = 1""")
def p9_sft_baseline_replicated(spark, sf_dir):
    return sft.sft_train_set(fx.f_log(spark, sf_dir), "baseline", 2)


@register("e13_sft_test_per_query", with_("flog") + f"""
SELECT query_id AS example_id, {_INSTR} AS instruction, query AS input, ground_truth AS output
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM flog WHERE split = 'test') t WHERE rn = 1""")
def e13_sft_test_per_query(spark, sf_dir):
    return sft.sft_test_set(fx.f_log(spark, sf_dir).where(F.col("split") == "test"))


@register("e13_sft_test_positional", with_("flog") + f"""
SELECT chunk AS example_id, {_INSTR} AS instruction, query AS input, ground_truth AS output FROM (
  SELECT *, (p - 1) // 40 AS chunk, count(*) OVER (PARTITION BY split) AS total FROM (
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY query_id, pos) AS p FROM flog WHERE split = 'test') a) b
WHERE (p - 1) % 40 = 0 AND chunk < total // 40""")
def e13_sft_test_positional(spark, sf_dir):
    return sft.sft_test_set(fx.f_log_once(spark, sf_dir).where(F.col("split") == "test"), mode="positional")
