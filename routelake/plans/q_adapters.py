"""Registered query with oracle: the fourteen benchmark adapters.

The DuckDB side rebuilds the same table-derived sources and renders the same
prompt templates (``functions.prompts``) with SQL string concatenation.
GPQA's option order uses an arithmetic seeded key so both engines agree.
"""

from __future__ import annotations

from routelake.functions import prompts as P
from routelake.plans.fixtures_sql import with_
from routelake.plans.q_assemble import adapted_queries, gpqa_key, lit_sql, render_sql
from routelake.plans.q_text import cap_sql
from routelake.plans.registry import register

THINK_SQL = " || chr(10) || 'Let''s think step by step.'"
LAB4 = "['A', 'B', 'C', 'D']"
OPTS4 = "[p_name, p_brand, p_type, 'none']"
DQ3 = '"""'


def _labelled(labels: str, texts: str) -> str:
    return (f"array_to_string(list_transform(list_zip({labels}, {texts}), "
            "lambda z: chr(10) || '(' || z[1] || ') ' || z[2]), '')")


def _lettered(texts: str) -> str:
    return f"array_to_string(list_transform({texts}, lambda x, i: chr(64 + CAST(i AS INTEGER)) || '. ' || x || chr(10)), '')"


def _clean(x: str) -> str:
    stripped = "regexp_replace(" + x + ", '^\\s+|\\s+$', '', 'g')"
    return "replace(regexp_replace(replace(" + stripped + ", ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ')"


def _row(task, sid, q, qt, gt, metric, frm, tid="NULL::VARCHAR"):
    return (f"SELECT {sid} AS source_id, '{task}' AS task_name, {lit_sql(P.TASK_DESCRIPTIONS[task])} AS task_description, "
            f"{tid} AS task_id, {q} AS query, {qt} AS query_think, {gt} AS ground_truth, '{metric}' AS metric {frm}")


def _tpl(name, think=False, **exprs):
    return render_sql(P.TEMPLATES[(name, think)], **exprs)


def adapters_sql() -> str:
    conv_id = "CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)"
    q100 = "text"
    mmlu_q = _tpl("mc", question="'Which describes ' || p_name", options=_lettered(OPTS4))
    order = ("list_sort(list_transform(range(4), lambda i: {'k': (p_partkey * 31 + i * 17 + 42) % 1009, 'i': i}))")
    gp_texts = f"list_transform({order}, lambda s: [p_brand, p_type, 'none', 'all'][s.i + 1])"
    gp_pos = f"list_position(list_transform({order}, lambda s: s.i), 0)"
    gpqa_q = _tpl("mc", question="p_name", options=_lettered(gp_texts))
    tests = "'assert f() == ''' || p_brand || ''''"
    mbpp_q = _tpl("mbpp", text="'Write ' || p_name", tests=tests)
    he_prompt = "'def f():' || chr(10) || '    " + DQ3 + "' || p_name || '" + DQ3 + "' || chr(10)"
    he_q = _tpl("humaneval", prompt=he_prompt)
    cap = cap_sql("text")
    hq = _clean("lang || ': ' || text || ' [title] x' || ' ' || " + cap)
    hends = "[" + ", ".join(_clean(e) for e in ["text", "'so ' || text", "'[x] end'", "'other'"]) + "]"
    arc_opts = _labelled("['A', 'B', 'C']", "[p_name, p_brand, 'none']")
    parts = [
        _row("natural_qa", conv_id, "ground_truth", "ground_truth" + THINK_SQL, "prediction", "cem", "FROM fpair"),
        _row("trivia_qa", conv_id, "ground_truth", "ground_truth" + THINK_SQL, "prediction", "cem", "FROM fpair"),
        _row("squad", "CAST(doc_id AS VARCHAR)", _tpl("qa", context="text", query=q100),
             _tpl("qa", True, context="text", query=q100), "string_split(text, ' ')[1]", "cem",
             "FROM documents"),
        _row("boolq", "CAST(doc_id AS VARCHAR)", _tpl("bool", context="text", query=q100),
             _tpl("bool", True, context="text", query=q100), "CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END",
             "cem", "FROM documents"),
        _row("mmlu", "CAST(p_partkey AS VARCHAR)", mmlu_q, mmlu_q + THINK_SQL, "chr(65 + CAST(p_partkey % 4 AS INTEGER))",
             "em_mc", "FROM part"),
        _row("gpqa", "CAST(p_partkey AS VARCHAR)", gpqa_q, gpqa_q + THINK_SQL, f"chr(64 + CAST({gp_pos} AS INTEGER))",
             "em_mc", "FROM part"),
        _row("mbpp", "CAST(p_partkey AS VARCHAR)", mbpp_q, mbpp_q + THINK_SQL,
             "'[\"assert f() == ''' || p_brand || '''\"]'", "code_eval", "FROM part", tid="CAST(p_partkey AS VARCHAR)"),
        _row("human_eval", "'HumanEval/' || CAST(p_partkey AS VARCHAR)", he_q, he_q + THINK_SQL,
             "'assert f() == ' || CAST(p_size AS VARCHAR)", "code_eval", "FROM part",
             tid="'HumanEval/' || CAST(p_partkey AS VARCHAR)"),
        _row("gsm8k", "CAST(doc_id AS VARCHAR)", _tpl("gsm8k", query=q100), _tpl("gsm8k", True, query=q100),
             "'work #### ' || CAST(doc_id % 100 AS VARCHAR)", "GSM8K", "FROM documents"),
        _row("commonsense_qa", "CAST(p_partkey AS VARCHAR)", _tpl("choice", query="p_name", options=_labelled(LAB4, OPTS4)),
             _tpl("choice", True, query="p_name", options=_labelled(LAB4, OPTS4)),
             "chr(65 + CAST(p_partkey % 4 AS INTEGER))", "em_mc", "FROM part"),
        _row("math", "CAST(doc_id AS VARCHAR)", _tpl("math", query=q100), _tpl("math", True, query=q100),
             "'so \\boxed{' || CAST(doc_id % 9 AS VARCHAR) || '}'", "MATH", "FROM documents"),
        _row("openbook_qa", "CAST(p_partkey AS VARCHAR)", _tpl("choice", query="p_name", options=_labelled(LAB4, OPTS4)),
             _tpl("choice", True, query="p_name", options=_labelled(LAB4, OPTS4)),
             "chr(65 + CAST(p_partkey % 4 AS INTEGER))", "em_mc", "FROM part"),
        _row("arc_challenge", "CAST(p_partkey AS VARCHAR)", _tpl("choice", query="p_type", options=arc_opts),
             _tpl("choice", True, query="p_type", options=arc_opts), "chr(65 + CAST(p_partkey % 3 AS INTEGER))",
             "em_mc", "FROM part"),
        _row("hellaswag", "CAST(doc_id AS VARCHAR)", _tpl("hellaswag", query=hq, options=_labelled(LAB4, hends)),
             _tpl("hellaswag", True, query=hq, options=_labelled(LAB4, hends)),
             "chr(65 + CAST(doc_id % 4 AS INTEGER))", "em_mc", "FROM documents"),
    ]
    return with_("fpair") + "\nUNION ALL\n".join(parts)


@register("a1_a14_adapters", adapters_sql())
def a1_a14_adapters(spark, sf_dir):
    """A1-A14 over table-derived sources; GPQA uses an arithmetic seeded
    option order so the oracle can reproduce it."""
    return adapted_queries(spark, sf_dir, gpqa_order=gpqa_key).select(
        "source_id", "task_name", "task_description", "task_id", "query", "query_think", "ground_truth", "metric")
