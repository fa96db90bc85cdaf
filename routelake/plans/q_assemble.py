"""Registered queries: log assembly (E11, J1 J2 J11 P7 P8 T21 T22), adapters
(A1-A15, U3), prompt builders (T9), math answers (T19 T20 E7), code scores
(E8), metric dispatch (E9) and the evaluation report (E16)."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import functions as F

from routelake.functions import mathtext as M
from routelake.functions import prompts as P
from routelake.functions import text as T
from routelake.functions.numeric import token_cost
from routelake.operators import assemble as A
from routelake.operators import ranking as R
from routelake.operators import scoring as S
from routelake.operators.common import r6, spread_if_narrow
from routelake.plans import fixtures as fx
from routelake.plans.fixtures_sql import R6, with_
from routelake.plans.registry import register


def lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render_sql(template: str, **exprs) -> str:
    parts = []
    for literal, field, _s, _c in Formatter().parse(template):
        if literal:
            parts.append(lit_sql(literal))
        if field is not None:
            parts.append(f"({exprs[field]})")
    return "(" + " || ".join(parts) + ")"


# ---------------------------------------------------------------- T9 / A10
_Q = "text"
_C = "lang || ': ' || text"


@register("t9_prompt_builders", f"""
SELECT doc_id,
  {render_sql(P.TEMPLATES[('qa', False)], context=_C, query=_Q)} AS qa,
  {render_sql(P.TEMPLATES[('qa', True)], context=_C, query=_Q)} AS qa_think,
  {render_sql(P.TEMPLATES[('bool', True)], context=_C, query=_Q)} AS bool_think,
  {render_sql(P.TEMPLATES[('gsm8k', False)], query=_Q)} AS gsm8k,
  {render_sql(P.TEMPLATES[('math', True)], query=_Q)} AS math_think,
  {render_sql(P.TEMPLATES[('humaneval', False)], prompt=_Q)} AS humaneval
FROM documents""")
def t9_prompt_builders(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    q, c = F.col("text"), F.concat("lang", F.lit(": "), "text")
    return d.select("doc_id", P.qa_prompt(c, q).alias("qa"), P.qa_prompt(c, q, True).alias("qa_think"),
                    P.bool_prompt(c, q, True).alias("bool_think"), P.gsm8k_prompt(q).alias("gsm8k"),
                    P.math_prompt(q, True).alias("math_think"), P.humaneval_prompt(q).alias("humaneval"))


_OPTS_SQL = "[p_name, p_brand, p_type, 'none of these']"
_LAB_SQL = "['A', 'B', 'C', 'D']"


@register("a10_choice_prompts", f"""
SELECT p_partkey,
  {render_sql(P.TEMPLATES[('choice', False)], query='p_name', options=f"array_to_string(list_transform(list_zip({_LAB_SQL}, {_OPTS_SQL}), lambda z: chr(10) || '(' || z[1] || ') ' || z[2]), '')")} AS choice,
  {render_sql(P.TEMPLATES[('hellaswag', True)], query='p_name', options=f"array_to_string(list_transform(list_zip({_LAB_SQL}, {_OPTS_SQL}), lambda z: chr(10) || '(' || z[1] || ') ' || z[2]), '')")} AS hellaswag_think,
  {render_sql(P.TEMPLATES[('mc', False)], question='p_name', options=f"array_to_string(list_transform({_OPTS_SQL}, lambda x, i: chr(64 + CAST(i AS INTEGER)) || '. ' || x || chr(10)), '')")} AS mc
FROM part""")
def a10_choice_prompts(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    opts = F.array("p_name", "p_brand", "p_type", F.lit("none of these"))
    labs = F.array(*[F.lit(x) for x in "ABCD"])
    return p.select("p_partkey", P.choice_prompt("p_name", labs, opts).alias("choice"),
                    P.hellaswag_prompt("p_name", labs, opts, True).alias("hellaswag_think"),
                    P.mc_prompt("p_name", opts).alias("mc"))


# ---------------------------------------------------------------- adapters
def adapter_sources(spark, sf_dir):
    """Nested benchmark-shaped sources derived from the test tables: (documents, fields of the five sources that read them, pairs, fields of the two
    sources that read them, tables of the others). The documents are shuffled only if their scan has fewer tasks than there are cores."""
    d = spread_if_narrow(fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), spark.sparkContext.defaultParallelism)
    part = fx.table(spark, sf_dir, "part")
    conv = fx.f_pair(spark, sf_dir)
    first = F.col("text")
    words = F.split(F.col("text"), " ")
    choices4 = F.array("p_name", "p_brand", "p_type", F.lit("none"))
    of_documents = {
        "squad": [F.col("doc_id").alias("id"), F.col("text").alias("context"), first.alias("question"),
                  F.struct(F.array(F.element_at(words, 1)).alias("text")).alias("answers")],
        "boolq": [F.col("doc_id").alias("id"), F.col("text").alias("passage"), first.alias("question"),
                  (F.col("doc_id") % 2 == 0).alias("answer")],
        "gsm8k": [F.col("doc_id").alias("id"), first.alias("question"),
                  F.concat(F.lit("work #### "), (F.col("doc_id") % 100).cast("string")).alias("answer")],
        "math": [F.col("doc_id").alias("id"), first.alias("problem"),
                 F.concat(F.lit("so \\boxed{"), (F.col("doc_id") % 9).cast("string"), F.lit("}")).alias("solution")],
        "hellaswag": [F.col("doc_id").alias("id"), F.concat("text", F.lit(" [title] x")).alias("ctx_a"),
                      F.col("text").alias("ctx_b"), F.col("lang").alias("activity_label"),
                      F.array(F.col("text"), F.concat(F.lit("so "), "text"), F.lit("[x] end"),
                              F.lit("other")).alias("endings"),
                      (F.col("doc_id") % 4).cast("string").alias("label")],
    }
    of_pairs = {
        "natural_qa": [F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("ground_truth").alias("question"),
                       F.array("prediction").alias("golden_answers")],
        "trivia_qa": [F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("ground_truth").alias("question"),
                      F.struct(F.array("prediction").alias("normalized_aliases")).alias("answer")],
    }
    others = {
        "mmlu": part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Which describes "), "p_name").alias("question"),
                            choices4.alias("choices"), (F.col("p_partkey") % 4).cast("int").alias("answer")),
        "gpqa": part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("Question"),
                            F.col("p_brand").alias("Correct Answer"), F.col("p_type").alias("Incorrect Answer 1"),
                            F.lit("none").alias("Incorrect Answer 2"), F.lit("all").alias("Incorrect Answer 3")),
        "mbpp": part.select(F.col("p_partkey").cast("int").alias("task_id"), F.concat(F.lit("Write "), "p_name").alias("text"),
                            F.array(F.concat(F.lit("assert f() == '"), "p_brand", F.lit("'"))).alias("test_list")),
        "human_eval": part.select(F.concat(F.lit("HumanEval/"), F.col("p_partkey").cast("string")).alias("task_id"),
                                  F.concat(F.lit("def f():\n    \"\"\""), "p_name", F.lit("\"\"\"\n")).alias("prompt"),
                                  F.lit("f").alias("entry_point"), F.concat(F.lit("assert f() == "), "p_size").alias("test")),
        "commonsense_qa": part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"),
                                      F.struct(F.array(*[F.lit(x) for x in "ABCD"]).alias("label"), choices4.alias("text")).alias("choices"),
                                      F.char(F.lit(65) + F.col("p_partkey") % 4).alias("answerKey")),
        "openbook_qa": part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question_stem"),
                                   F.struct(F.array(*[F.lit(x) for x in "ABCD"]).alias("label"), choices4.alias("text")).alias("choices"),
                                   F.char(F.lit(65) + F.col("p_partkey") % 4).alias("answerKey")),
        "arc_challenge": part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("question"),
                                     F.struct(F.array(*[F.lit(x) for x in "ABC"]).alias("label"),
                                              F.array("p_name", "p_brand", F.lit("none")).alias("text")).alias("choices"),
                                     F.char(F.lit(65) + F.col("p_partkey") % 3).alias("answerKey")),
    }
    return d, of_documents, conv, of_pairs, others


def adapted_queries(spark, sf_dir, gpqa_order=None):
    d, of_documents, conv, of_pairs, src = adapter_sources(spark, sf_dir)
    shared = lambda df, fields, **adapters: A.adapt_shared(df, {n: (fields[n], adapter) for n, adapter in adapters.items()})
    frames = [shared(conv, of_pairs, natural_qa=A.adapt_natural_qa, trivia_qa=A.adapt_trivia_qa),
              shared(d, of_documents, squad=A.adapt_squad, boolq=A.adapt_boolq, gsm8k=A.adapt_gsm8k, math=A.adapt_math, hellaswag=A.adapt_hellaswag),
              A.adapt_mmlu(src["mmlu"]), A.adapt_gpqa(src["gpqa"], order_key=gpqa_order),
              A.adapt_mbpp(src["mbpp"]), A.adapt_human_eval(src["human_eval"]),
              A.adapt_labelled_choice("commonsense_qa", src["commonsense_qa"]),
              A.adapt_labelled_choice("openbook_qa", src["openbook_qa"], question="question_stem"),
              A.adapt_labelled_choice("arc_challenge", src["arc_challenge"])]
    return A.union_sources(*frames)


@register("u3_adapter_union")
def u3_adapter_union(spark, sf_dir):
    """A1-A14 projections over table-derived sources, unioned (rows-only)."""
    u = adapted_queries(spark, sf_dir)
    return u.select("task_name", "source_id", "metric", "ground_truth", F.length("query").alias("query_len"),
                    F.length("query_think").alias("query_think_len"))


@register("a15_config_unify", """
SELECT CAST(doc_id AS VARCHAR) AS source_id, 'multi_news' AS task_name, lang || ': ' || text AS query,
       source AS ground_truth, 'f1_score' AS metric FROM documents""")
def a15_config_unify(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir).withColumn("sep", F.lit(": ")).withColumn("head", F.col("text")) \
        .withColumn("meta", F.struct(F.array("source").alias("names")))
    u = A.unify_config_source(d, "multi_news", ["lang", "sep", "head"], "meta", "names", 0, "f1_score", "doc_id")
    return u.select("source_id", "task_name", "query", "ground_truth", "metric")


@register("a15_source_shapes", """
SELECT CAST(doc_id AS VARCHAR) AS source_id, 'alpaca_data' AS task_name, 'Write in ' || lang || text AS query, source AS ground_truth, 'f1_score' AS metric FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'GSM8K', 'How many characters? ' || text, 'count #### ' || CAST(n_chars AS VARCHAR), 'GSM8K' FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'multi_news', 'Summarise: ' || text, source, 'f1_score' FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'SQUAD', text, CASE WHEN doc_id % 3 > 0 THEN source END, 'f1_score' FROM documents WHERE doc_id % 4 = 3""")
def a15_source_shapes(spark, sf_dir):
    """A15's four source shapes, united: two-part queries, answers with steps, and answer lists in a struct (empty ones give NULL)."""
    d = fx.f_txt(spark, sf_dir)
    of = lambda k: d.where(F.col("doc_id") % 4 == k)
    two = lambda k, head, **more: of(k).select(F.col("doc_id").alias("id"), head.alias("instruction"), F.col("text").alias("input"), *[c.alias(n) for n, c in more.items()])
    squad = of(3).select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.struct(
        F.when(F.col("doc_id") % 3 > 0, F.array("source", F.lit("another"))).otherwise(F.array().cast("array<string>")).alias("text")).alias("answers"))
    frames = {"alpaca_data": two(0, F.concat(F.lit("Write in "), "lang"), output=F.col("source")),
              "GSM8K": two(1, F.lit("How many characters? "), answer=F.concat(F.lit("count #### "), F.col("n_chars").cast("string"))),
              "multi_news": two(2, F.lit("Summarise: "), output=F.col("source")), "SQUAD": squad}
    return A.unify_sources(frames).select("source_id", "task_name", "query", "ground_truth", "metric")


# ---------------------------------------------------------------- E11 and parts
def fake_model(llm: str, prompt: str, gt: str) -> str:
    """Deterministic stand-in for a model call (knows the answer 1 time in 3)."""
    idx = int(llm.rsplit("_", 1)[-1])
    return f"I think it is {gt}" if (idx + len(prompt)) % 3 == 0 else "I do not know"


def _grid_queries(spark, sf_dir):
    q = fx.f_grid_queries(spark, sf_dir)
    return q.select("query_id", "task_name", F.lit(None).cast("string").alias("task_id"),
                    P.task_description(F.lit("natural_qa")).alias("task_description"), "query",
                    A._think(F.col("query")).alias("query_think"), "ground_truth", F.lit("cem").alias("metric"))


def _grid_catalogue(spark, sf_dir):
    return fx.f_grid_catalogue(spark, sf_dir).where(~F.col("is_think")).select(
        "llm", "llm_idx", "input_price", "output_price", "llm_description")


_E11_SQL = with_("fgrid", extra={"x": """
SELECT query_id, llm, llm_idx, is_think, input_price, output_price, ground_truth,
       CASE WHEN is_think THEN query || chr(10) || 'Let''s think step by step.' ELSE query END AS prompt FROM fgrid""", "y": """
SELECT *, CASE WHEN (llm_idx + length(prompt)) % 3 = 0 THEN 'I think it is ' || ground_truth ELSE 'I do not know' END AS response FROM x""", "z": """
SELECT *, CAST(len(regexp_extract_all(prompt, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS input_tokens_num,
          CAST(len(regexp_extract_all(response, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS output_tokens_num FROM y"""}) + """
SELECT query_id, llm, is_think, input_tokens_num, output_tokens_num,
  """ + R6("input_tokens_num * input_price + output_tokens_num * output_price") + """ AS cost,
  CASE WHEN array_to_string(list_filter(string_split_regex(regexp_replace(lower(response), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')
         = array_to_string(list_filter(string_split_regex(regexp_replace(lower(ground_truth), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')
       OR contains(array_to_string(list_filter(string_split_regex(regexp_replace(lower(response), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' '),
                   array_to_string(list_filter(string_split_regex(regexp_replace(lower(ground_truth), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' '))
       THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS performance
FROM z"""


@register("e11_log_assembly", _E11_SQL)
def e11_log_assembly(spark, sf_dir):
    log = A.assemble_log(_grid_queries(spark, sf_dir), _grid_catalogue(spark, sf_dir), fake_model)
    return log.select("query_id", "llm", "is_think", "input_tokens_num", "output_tokens_num",
                      r6("cost").alias("cost"), "performance")


@register("j1_work_list", with_("fgrid") + "SELECT query_id, llm, llm_idx FROM fgrid")
def j1_work_list(spark, sf_dir):
    wl = A.work_list(fx.f_grid_queries(spark, sf_dir), fx.f_grid_catalogue(spark, sf_dir))
    return wl.select("query_id", "llm", "llm_idx")


@register("j2_catalogue_lookup", with_("flog") + """
SELECT f.query_id, f.llm, (n.n_regionkey + 1)::DOUBLE / 10.0 AS input_price FROM flog f LEFT JOIN nation n ON f.llm = n.n_name""")
def j2_catalogue_lookup(spark, sf_dir):
    cat = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("llm"),
                                                  ((F.col("n_regionkey") + 1).cast("double") / 10.0).alias("input_price"))
    return A.catalogue_lookup(fx.f_log(spark, sf_dir), cat).select("query_id", "llm", "input_price")


@register("t21_token_cost", with_("fgrid") + f"""
SELECT query_id, llm, {R6('input_tokens_num * input_price + output_tokens_num * output_price')} AS cost FROM fgrid""")
def t21_token_cost(spark, sf_dir):
    g = fx.f_grid(spark, sf_dir)
    return g.select("query_id", "llm", r6(token_cost("input_tokens_num", "output_tokens_num",
                                                      "input_price", "output_price")).alias("cost"))


@register("t22_token_estimate", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS n_tokens FROM documents""")
def t22_token_estimate(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    return d.select("doc_id", T.token_count_estimate("text").alias("n_tokens"))


@register("p7_unpivot_think", with_("flog") + """
SELECT query_id, llm, false AS is_think, response AS text FROM flog
UNION ALL SELECT query_id, llm || '_think', true, upper(response) FROM flog""")
def p7_unpivot_think(spark, sf_dir):
    f = fx.f_log(spark, sf_dir).select("query_id", "llm", "response", F.upper("response").alias("response_think"))
    u = A.unpivot_think(f, {"text": "response"}, {"text": "response_think"})
    return u.select("query_id", "llm", "is_think", "text")


@register("p8_first_row_value", with_("flog") + """
SELECT query_id, llm, first_value(v) OVER (PARTITION BY query_id ORDER BY pos) AS v FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY pos) = 1 THEN ground_truth END AS v FROM flog) t""")
def p8_first_row_value(spark, sf_dir):
    f = fx.f_log(spark, sf_dir).withColumn("v", F.col("ground_truth"))
    f = A.keep_on_first_row(f, "v")
    return A.fill_from_first(f, "v").select("query_id", "llm", "v")


# ---------------------------------------------------------------- math
def _math_pairs(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    k = F.col("doc_id") % 6
    n = (F.col("doc_id") % 9).cast("string")
    pred = (F.when(k == 0, F.concat(F.lit("so \\boxed{"), n, F.lit("}")))
             .when(k == 1, F.concat(F.lit("\\boxed{\\frac"), n, F.lit("2}")))
             .when(k == 2, F.concat("text", F.lit(" \\boxed "), n, F.lit("$ end")))
             .when(k == 3, F.concat(F.lit("\\boxed{x = "), n, F.lit("\\%}")))
             .when(k == 4, F.concat(F.lit("\\fbox{"), n, F.lit("}")))
             .otherwise(F.col("text")))
    gt = F.concat(F.lit("so \\boxed{"), n, F.lit("}"))
    return d.select("doc_id", pred.alias("prediction"), gt.alias("ground_truth"))


def _replaced(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {old}, {new})"
    return x


#: T19, T20 and E7 in SQL, step by step, for both sides (p: prediction, g: truth).
_MATH_SQL = {
    "pair": r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'so \boxed{' || doc_id % 9 || '}' WHEN 1 THEN '\boxed{\frac' || doc_id % 9 || '2}'
                  WHEN 2 THEN text || ' \boxed ' || doc_id % 9 || '$ end' WHEN 3 THEN '\boxed{x = ' || doc_id % 9 || '\%}' WHEN 4 THEN '\fbox{' || doc_id % 9 || '}' ELSE text END AS p,
                'so \boxed{' || doc_id % 9 || '}' AS g FROM ftxt""",
    "m0": "SELECT doc_id, 'p' AS side, p AS s FROM pair UNION ALL SELECT doc_id, 'g', g FROM pair",
    "m1": r"""SELECT *, CASE WHEN contains(s, '\boxed') THEN substr(s, length(s) - length(string_split(s, '\boxed')[-1]) - 5)
                   WHEN contains(s, '\fbox') THEN substr(s, length(s) - length(string_split(s, '\fbox')[-1]) - 4) END AS tail FROM m0""",
    "m2": """SELECT doc_id, side, min(i) FILTER (WHERE ch = '}' AND depth = 0) AS stop FROM (
               SELECT *, sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, side ORDER BY i) AS depth FROM (
                 SELECT doc_id, side, unnest(string_split(tail, '')) AS ch, unnest(range(1, length(tail) + 1)) AS i FROM m1) t) u GROUP BY doc_id, side""",
    "m3": r"""SELECT m1.doc_id, m1.side, s, CASE WHEN contains(s, '\boxed ') THEN '\boxed ' || string_split(string_split(s, '\boxed ')[-1], '$')[1]
                   WHEN stop IS NOT NULL THEN substr(tail, 1, stop) END AS boxed
              FROM m1 LEFT JOIN m2 ON m1.doc_id = m2.doc_id AND m1.side = m2.side""",
    "m4": r"""SELECT *, CASE WHEN contains(boxed, '\boxed ') THEN CASE WHEN starts_with(boxed, '\boxed ') THEN substr(boxed, 8) END
                   WHEN starts_with(boxed, '\boxed{') AND ends_with(boxed, '}') THEN substr(boxed, 8, length(boxed) - 8) END AS raw FROM m3""",
    "c1": "SELECT *, " + _replaced("raw", [("chr(10)", "''"), (r"'\!'", "''"), (r"'\\'", r"'\'"), ("'tfrac'", "'frac'"), ("'dfrac'", "'frac'"), (r"'\left'", "''"),
                                            (r"'\right'", "''"), (r"'^{\circ}'", "''"), (r"'^\circ'", "''"), (r"'\$'", "''")]) + " AS a FROM m4",
    "c2": r"""SELECT * EXCLUDE a, CASE WHEN NOT contains(a, '\text{ ') THEN a WHEN len(string_split(a, '\text{ ')) = 2 THEN string_split(a, '\text{ ')[1] END AS a FROM c1""",
    "c3": "SELECT * EXCLUDE a, " + _replaced("a", [(r"'\%'", "''"), ("' .'", "' 0.'"), ("'{.'", "'{0.'")]) + " AS a FROM c2",
    "c4": "SELECT *, CASE WHEN starts_with(a, '.') THEN '0' || a ELSE a END AS t FROM c3",
    "c5": "SELECT * EXCLUDE t, CASE WHEN len(string_split(t, '=')) = 2 AND length(string_split(t, '=')[1]) <= 2 THEN string_split(t, '=')[2] ELSE t END AS t FROM c4",
    "c6": r"""SELECT * EXCLUDE t, replace(CASE WHEN NOT contains(t, '\sqrt') THEN t WHEN list_contains(string_split(t, '\sqrt')[2:], '') THEN NULL
                ELSE string_split(t, '\sqrt')[1] || array_to_string(list_transform(string_split(t, '\sqrt')[2:], lambda x:
                  CASE WHEN x[1] <> '{' THEN '\sqrt{' || x[1] || '}' || substr(x, 2) ELSE '\sqrt' || x END), '') END, ' ', '') AS t FROM c5""",
    "c7": r"""SELECT *, string_split(t, '\frac') AS fr, list_filter(list_transform(string_split(t, '\frac')[2:], lambda x:
                CASE WHEN x = '' THEN 'err' WHEN x[1] = '{' THEN 'ok' WHEN length(x) < 2 THEN 'short' ELSE 'ok' END), lambda k: k <> 'ok')[1] AS bad FROM c6""",
    "c8": r"""SELECT * EXCLUDE t, CASE WHEN len(fr) <= 1 THEN t WHEN bad = 'err' THEN NULL WHEN bad = 'short' THEN t
                ELSE fr[1] || array_to_string(list_transform(fr[2:], lambda x: '\frac' || CASE WHEN x[1] = '{' THEN x
                  WHEN x[2] <> '{' THEN '{' || x[1] || '}{' || x[2] || '}' || substr(x, 3) ELSE '{' || x[1] || '}' || x[2] || substr(x, 3) END), '') END AS t FROM c7""",
    "c9": r"SELECT * EXCLUDE t, CASE WHEN t = '0.5' THEN '\frac{1}{2}' ELSE t END AS t FROM c8",
    "ca": r"""SELECT doc_id, side, s, boxed, raw, CASE WHEN length(a) = 0 THEN '' WHEN len(string_split(t, '/')) <> 2 THEN t
                WHEN regexp_matches(string_split(t, '/')[1], '^-?(0|[1-9][0-9]*)$') AND regexp_matches(string_split(t, '/')[2], '^-?(0|[1-9][0-9]*)$')
                     AND string_split(t, '/')[1] <> '-0' AND string_split(t, '/')[2] <> '-0'
                  THEN '\frac{' || string_split(t, '/')[1] || '}{' || string_split(t, '/')[2] || '}'
                WHEN regexp_matches(string_split(t, '/')[1], '^[+-]?[0-9]+(_[0-9]+)*$') AND regexp_matches(string_split(t, '/')[2], '^[+-]?[0-9]+(_[0-9]+)*$') THEN t
                END AS canonical FROM c9""",
}


def _math_sql(final: str) -> str:
    return with_("ftxt", extra=_MATH_SQL) + final


@register("t19_last_boxed", _math_sql(" SELECT doc_id, boxed FROM m3 WHERE side = 'p'"))
def t19_last_boxed(spark, sf_dir):
    p = _math_pairs(spark, sf_dir)
    return p.select("doc_id", M.last_boxed("prediction").alias("boxed"))


@register("t20_canonical_answer", _math_sql(" SELECT doc_id, canonical FROM ca WHERE side = 'p'"))
def t20_canonical_answer(spark, sf_dir):
    p = _math_pairs(spark, sf_dir)
    return p.select("doc_id", M.canonical_answer(M.remove_boxed(M.last_boxed("prediction"))).alias("canonical"))


@register("e7_math_score", _math_sql("""
 SELECT p.doc_id, CASE WHEN g.raw IS NULL OR p.s IS NULL THEN NULL WHEN p.boxed IS NULL OR p.raw IS NULL THEN 0.0::DOUBLE
   WHEN p.canonical IS NULL OR g.canonical IS NULL THEN CAST(p.raw = g.raw AS DOUBLE) ELSE CAST(p.canonical = g.canonical AS DOUBLE) END AS score
 FROM ca p JOIN ca g ON p.doc_id = g.doc_id AND p.side = 'p' AND g.side = 'g'"""))
def e7_math_score(spark, sf_dir):
    p = _math_pairs(spark, sf_dir)
    return p.select("doc_id", M.math_score("prediction", "ground_truth").alias("score"))


# ---------------------------------------------------------------- E8 / E9 / E16
@register("e8_code_scores", with_("fcode", extra={"per": """
SELECT task_id, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM fcode GROUP BY task_id"""}) + f"""
SELECT p.p_partkey AS task_id, {R6("CASE WHEN per.n IS NULL THEN 0.0 WHEN per.c = 0 THEN 0.0 ELSE per.c::DOUBLE / per.n END")} AS pass_at_1
FROM part p LEFT JOIN per ON p.p_partkey = per.task_id""")
def e8_code_scores(spark, sf_dir):
    """Per-problem pass@1 from an execution-results table; a problem with
    no results scores 0 (J3 left join + default)."""
    res = fx.f_code(spark, sf_dir)
    per = res.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"))
    problems = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"))
    j = problems.join(per, "task_id", "left")
    return j.select("task_id", r6(F.coalesce(R.pass_at_k_per_problem("n", "c", 1), F.lit(0.0))).alias("pass_at_1"))


def _scored_input(spark, sf_dir):
    return S.with_code_scores(fx.f_score(spark, sf_dir), fx.f_code(spark, sf_dir))


def _scored_pairs(spark, sf_dir):
    # Code results are joined per problem (J3); the MATH branch uses E7.
    return _scored_input(spark, sf_dir).select(
        "conv_id", "turn", "task_name",
        S.score_by_metric("prediction", "ground_truth", "metric", "task_name", code_pass="code_pass").alias("score"))


def _e9_ctes() -> dict:
    from routelake.plans.fixtures_sql import FSCORE_SQL
    return {"fscore": FSCORE_SQL,
            "per": "SELECT task_id, count(*) FILTER (WHERE passed)::DOUBLE / count(*) AS code_pass FROM fcode GROUP BY task_id",
            "sc": _e9_sql()}


def _e9_sql() -> str:
    from routelake.plans.q_text import last_paren_sql, norm_sql, strip_sql
    p, g = "prediction", "ground_truth"
    em = f"CAST({norm_sql(p)} = {norm_sql(g)} AS DOUBLE)"
    cem = f"CASE WHEN {norm_sql(p)} = {norm_sql(g)} OR contains({norm_sql(p)}, {norm_sql(g)}) THEN 1.0 ELSE 0.0 END"
    choice = f"CAST(contains(lower({strip_sql(last_paren_sql(p))}), lower({strip_sql(g)})) AS DOUBLE)"
    runs = f"regexp_extract_all({p}, '(-?[0-9.,]+)', 1)"
    gp = strip_sql(f"translate(coalesce(list_filter({runs}, lambda r: r NOT IN ('', '.'))[-1], {runs}[1]), ',$.', '')")
    gg = strip_sql(f"translate(string_split({g}, '####')[-1], ',$.', '')")
    gsm = f"CASE WHEN {gp} IS NULL THEN 0.0 WHEN {gp} = {gg} THEN 1.0 ELSE 0.0 END"
    # F-SCORE's boxed answers are whole numbers, equivalent only if equal
    boxed = lambda x: f"regexp_extract({x}, 'boxed\\{{([0-9]+)\\}}$', 1)"
    tok = lambda x: f"list_filter(string_split({norm_sql(x)}, ' '), lambda t: t <> '')"
    same = (f"list_sum(list_transform(list_distinct({tok(p)}), lambda u: least(len(list_filter({tok(p)}, lambda t: t = u)), "
            f"len(list_filter({tok(g)}, lambda t: t = u)))))")
    f1 = f"coalesce(2.0 * {same} / nullif(len({tok(p)}) + len({tok(g)}), 0), 0.0)"
    return f"""
SELECT conv_id, turn, task_name, metric, CASE WHEN {p} IS NULL OR {g} IS NULL THEN NULL
  WHEN m = 'em' THEN {em} WHEN m = 'f1_score' THEN {f1}
  WHEN m = 'cem' THEN {cem} WHEN m = 'em_mc' THEN {choice} WHEN m = 'GSM8K' THEN {gsm}
  WHEN m = 'MATH' THEN CAST({boxed(p)} = {boxed(g)} AS DOUBLE) WHEN m = 'code_eval' THEN coalesce(code_pass, 0.0)
  ELSE 0.0 END::DOUBLE AS score
FROM (SELECT fscore.*, per.code_pass, CASE WHEN task_name IN ('natural_qa', 'trivia_qa', 'squad', 'boolq') THEN 'cem' ELSE metric END AS m
      FROM fscore LEFT JOIN per ON per.task_id = fscore.task_id) t"""


@register("e9_metric_dispatch", with_("fpair", "fcode", extra={**_e9_ctes()}) + f"""
SELECT conv_id, turn, task_name, {R6('score')} AS score FROM sc""")
def e9_metric_dispatch(spark, sf_dir):
    return _scored_pairs(spark, sf_dir).select("conv_id", "turn", "task_name", r6("score").alias("score"))


@register("e16_evaluation_report", with_("fpair", "fcode", extra={**_e9_ctes(), "c": """
SELECT task_name, score, CASE WHEN task_name IN ('gsm8k','math') THEN 'math' WHEN task_name IN ('mbpp','human_eval') THEN 'code'
  WHEN task_name IN ('commonsense_qa','openbook_qa','arc_challenge','hellaswag') THEN 'commonsense'
  WHEN task_name IN ('natural_qa','trivia_qa') THEN 'world_knowledge' WHEN task_name IN ('squad','boolq') THEN 'reading'
  WHEN task_name IN ('mmlu','gpqa') THEN 'popular' END AS category FROM sc WHERE score IS NOT NULL"""}) + f"""
SELECT CASE WHEN grouping(task_name) = 0 THEN 'task' WHEN grouping(category) = 0 THEN 'category' ELSE 'total' END AS level,
       coalesce(task_name, category, 'all') AS name, {R6('avg(score)')} AS mean_score, count(*) AS n
FROM c GROUP BY GROUPING SETS ((task_name), (category), ()) HAVING grouping(category) = 1 OR category IS NOT NULL""")
def e16_evaluation_report(spark, sf_dir):
    rep = S.evaluation_report(_scored_pairs(spark, sf_dir))
    return rep.select("level", "name", r6("mean_score").alias("mean_score"), "n")


@register("j11_log_embeddings", with_("fgrid", "fvec") + f"""
SELECT g.query_id, g.llm, len(v.embedding) AS dims, {R6('v.embedding[1]')} AS first, {R6('list_sum(v.embedding)')} AS total,
       {R6('list_dot_product(v.embedding, v.embedding)')} AS squares
FROM fgrid g LEFT JOIN fvec v ON g.query_id = v.vec_id""")
def j11_log_embeddings(spark, sf_dir):
    """The assembled log joined with the query-embedding table (QUERY_EMB); of each vector its length, first component, sum and square sum."""
    emb = fx.f_vec(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    out = A.join_embeddings(fx.f_grid(spark, sf_dir).select("query_id", "llm"), emb)
    add = lambda f: F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + f(x))
    return out.select("query_id", "llm", F.size("embedding").cast("bigint").alias("dims"), r6(F.get("embedding", F.lit(0))).alias("first"),
                      r6(add(lambda x: x)).alias("total"), r6(add(lambda x: x * x)).alias("squares"))


@register("t10_judge_prompt", with_("flog") + """
SELECT query_id, llm, """ + lit_sql(__import__("routelake.operators.batch", fromlist=["x"]).JUDGE_HEAD + "Query: ")
          + """ || query || chr(10) || 'Ground Truth: ' || ground_truth || chr(10) || 'Response: ' || response || """
          + lit_sql(__import__("routelake.operators.batch", fromlist=["x"]).JUDGE_TAIL) + """ AS prompt FROM flog""")
def t10_judge_prompt(spark, sf_dir):
    from routelake.operators.batch import judge_prompt
    return fx.f_log(spark, sf_dir).select("query_id", "llm", judge_prompt().alias("prompt"))


@register("t24_cosine_similarity", with_("fvec") + f"""
SELECT a.vec_id, {R6("CASE WHEN sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding)) = 0 THEN 0.0 ELSE list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))) END")} AS cosine
FROM fvec a JOIN fvec b ON b.vec_id = a.vec_id + 1""")
def t24_cosine_similarity(spark, sf_dir):
    """T24 on consecutive vector pairs (an equi join on id + 1)."""
    from routelake.functions.numeric import cosine
    v = fx.f_vec(spark, sf_dir)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return v.join(nxt, "vec_id").select("vec_id", r6(cosine("embedding", "e2")).alias("cosine"))


def gpqa_key(ident, i):
    """Seeded arithmetic option order for GPQA (the same value in Spark and SQL)."""
    return (ident * 31 + i * 17 + 42) % 1009


@register("g1_mean_per_task", with_("fpair", "fcode", extra={**_e9_ctes()}) + f"""
SELECT task_name, {R6('avg(score)')} AS mean_score, count(*) AS n FROM sc WHERE score IS NOT NULL GROUP BY task_name""")
def g1_mean_per_task(spark, sf_dir):
    """G1: mean score per task; rows without a score are left out."""
    s = _scored_pairs(spark, sf_dir).where(F.col("score").isNotNull())
    return s.groupBy("task_name").agg(r6(F.avg("score")).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@register("g2_mean_per_category", with_("fpair", "fcode", extra={**_e9_ctes()}) + f"""
SELECT category, {R6('avg(score)')} AS mean_score, count(*) AS n FROM (
  SELECT score, CASE WHEN task_name IN ('gsm8k','math') THEN 'math' WHEN task_name IN ('mbpp','human_eval') THEN 'code'
    WHEN task_name IN ('commonsense_qa','openbook_qa','arc_challenge','hellaswag') THEN 'commonsense'
    WHEN task_name IN ('natural_qa','trivia_qa') THEN 'world_knowledge' WHEN task_name IN ('squad','boolq') THEN 'reading'
    WHEN task_name IN ('mmlu','gpqa') THEN 'popular' END AS category FROM sc WHERE score IS NOT NULL) t
WHERE category IS NOT NULL GROUP BY category""")
def g2_mean_per_category(spark, sf_dir):
    """Mean score per category; categories without scored rows are omitted."""
    s = _scored_pairs(spark, sf_dir).where(F.col("score").isNotNull()).withColumn("category", S.category_of("task_name"))
    return (s.where(F.col("category").isNotNull()).groupBy("category")
             .agg(r6(F.avg("score")).alias("mean_score"), F.count(F.lit(1)).alias("n")))
