"""DuckDB definitions of the fixtures in ``plans.fixtures`` (as CTE bodies).

Oracle SQL strings are ``with_(...)`` + a final SELECT.  DuckDB dialect notes:
lambdas are ``lambda x: ...``; regex escapes are single (``\\s`` in Python
source gives ``\\s`` to DuckDB); integer division is ``//``.
"""

from __future__ import annotations

TASK_LIST_SQL = ("['natural_qa','trivia_qa','squad','boolq','mmlu','gpqa','mbpp','human_eval',"
                 "'gsm8k','commonsense_qa','math','openbook_qa','arc_challenge','hellaswag']")

METRIC_CASE_SQL = """CASE WHEN task_name IN ('natural_qa','trivia_qa','squad','boolq') THEN 'cem'
  WHEN task_name IN ('mbpp','human_eval') THEN 'code_eval'
  WHEN task_name = 'gsm8k' THEN 'GSM8K' WHEN task_name = 'math' THEN 'MATH'
  ELSE 'em_mc' END"""

CTES = {
    "flog": """
SELECT query_id, task_name, llm, llm_idx, query, ground_truth, concat(llm, ' ', query) AS response,
       performance, cost, llm_judge, input_tokens_num, output_tokens_num,
       CASE WHEN query_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY llm) AS BIGINT) AS pos
FROM (
  SELECT l.l_partkey AS query_id, p.p_type AS task_name, n.n_name AS llm, n.n_nationkey AS llm_idx,
         p.p_name AS query, p.p_brand AS ground_truth,
         max(l.l_discount) AS performance, min(l.l_extendedprice) AS cost, max(l.l_tax) AS llm_judge,
         CAST(count(*) AS BIGINT) AS input_tokens_num, CAST(max(l.l_quantity) AS BIGINT) AS output_tokens_num
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY l.l_partkey, p.p_type, n.n_name, n.n_nationkey, p.p_brand, p.p_name) g""",
    "fgrid": """
SELECT CAST(p.p_partkey * 50 + n.n_nationkey * 2 + t.th AS BIGINT) AS pos,
       p.p_partkey AS query_id, p.p_type AS task_name, concat('What is ', p.p_name, '?') AS query,
       p.p_brand AS ground_truth,
       CASE WHEN t.th = 1 THEN n.n_name || '_think' ELSE n.n_name END AS llm,
       n.n_nationkey AS llm_idx, t.th = 1 AS is_think,
       (n.n_regionkey + 1)::DOUBLE / 10.0 AS input_price, (n.n_regionkey + 2)::DOUBLE / 10.0 AS output_price,
       CAST(p.p_size + 25 * t.th AS BIGINT) AS input_tokens_num,
       CAST((p.p_partkey * 7 + n.n_nationkey * 13 + t.th * 5) % 97 + 1 AS BIGINT) AS output_tokens_num,
       ((p.p_partkey * 31 + n.n_nationkey * 17 + t.th * 11) % 11)::DOUBLE / 10.0 AS performance,
       CAST(p.p_size + 25 * t.th AS BIGINT) * ((n.n_regionkey + 1)::DOUBLE / 10.0)
         + CAST((p.p_partkey * 7 + n.n_nationkey * 13 + t.th * 5) % 97 + 1 AS BIGINT) * ((n.n_regionkey + 2)::DOUBLE / 10.0) AS cost
FROM part p, nation n, (SELECT 0 AS th UNION ALL SELECT 1) t""",
    "fpair": f"""
SELECT conv_id, turn, text AS ground_truth, next_text AS prediction,
       {TASK_LIST_SQL}[conv_id % 14 + 1] AS task_name,
       {METRIC_CASE_SQL.replace('task_name', TASK_LIST_SQL + '[conv_id % 14 + 1]')} AS metric
FROM (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
      FROM conversations) c
WHERE role = 'user' AND next_role = 'assistant'""",
    "ftxt": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "fvec": """
SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding, label,
       'model_' || CAST(label AS VARCHAR) AS model,
       CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM embeddings""",
    "fevt": """
SELECT event_id, ts, user_id, value, event_type AS task_name,
       '<answer>' || json_extract_string(props, '$.k') || '</answer>' AS reply,
       event_type = 'error' AS failed, CAST(dayofmonth(ts) AS INTEGER) AS run_id
FROM events""",
    "fcode": """
SELECT l_partkey AS task_id, l_orderkey, l_linenumber, l_returnflag = 'R' AS passed FROM lineitem""",
}


def R6(expr: str) -> str:
    """SQL twin of ``operators.common.r6``."""
    return f"(round(({expr}) * 1000000.0) / 1000000.0)"


#: F-SCORE over the CTE ``fpair``.
FSCORE_SQL = r"""
SELECT conv_id, turn, conv_id AS task_id, task_name, m AS metric,
  CASE m WHEN 'em_mc' THEN substr('ABCD', k + 1, 1) WHEN 'GSM8K' THEN g || ' #### ' || n WHEN 'MATH' THEN g || ' \boxed{' || n || '}' ELSE g END AS ground_truth,
  CASE WHEN k = 3 AND conv_id % 2 = 1 THEN NULL WHEN m = 'em_mc' THEN a || ' The answer is (' || substr('ABCD', (conv_id % 2)::INTEGER + 1, 1) || ')'
    WHEN m = 'GSM8K' THEN a || ' so ' || said WHEN m = 'MATH' THEN a || ' \boxed{' || said || '}'
    WHEN m = 'f1_score' AND k = 0 THEN g || ' ' || a WHEN m = 'em' AND k = 0 THEN 'The ' || g
    WHEN m = 'cem' AND k = 0 THEN 'So: ' || g ELSE a END AS prediction
FROM (SELECT *, ground_truth AS g, prediction AS a, conv_id % 50 AS n, conv_id % 50 + CASE WHEN k = 0 THEN 0 ELSE 1 END AS said,
        CASE WHEN k < 2 AND task_name = 'openbook_qa' THEN 'em' WHEN k < 2 AND task_name = 'arc_challenge' THEN 'f1_score' ELSE metric END AS m
      FROM (SELECT *, ((conv_id // 14 + turn // 2) % 4)::INTEGER AS k FROM fpair) x) y"""


def with_(*names: str, extra: dict | None = None) -> str:
    """``WITH`` clause defining the named fixtures (plus extra named CTEs, in order)."""
    parts = [f"{n} AS ({CTES[n]})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    return "WITH " + ",\n".join(parts) + "\n"
