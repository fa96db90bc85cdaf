"""Registered queries: text expressions (T*) and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelake.functions import text as T
from routelake.operators import scoring as S
from routelake.operators.common import r6
from routelake.plans import fixtures as fx
from routelake.plans.fixtures_sql import R6, with_
from routelake.plans.registry import register

# ---- DuckDB twins of the text builders (RE2 dialect, 'g' = replace all).
_PUNCT = r"'[!-/:-@\[-`{-~]'"


def tok_sql(x: str) -> str:
    runs = "regexp_replace(regexp_replace(lower(" + x + "), " + _PUNCT + ", '', 'g'), '([\\p{L}\\p{M}\\p{N}_]+)', chr(1) || '\\1' || chr(1), 'g')"
    for article in ("a", "an", "the"):  # a run of word characters that is an article becomes a blank
        runs = f"replace({runs}, chr(1) || '{article}' || chr(1), ' ')"
    return f"list_filter(string_split_regex(replace({runs}, chr(1), ''), '\\s+'), lambda t: t <> '')"


def norm_sql(x: str) -> str:
    return "array_to_string(" + tok_sql(x) + ", ' ')"


def strip_sql(x: str) -> str:
    return "regexp_replace(" + x + ", '^\\s+|\\s+$', '', 'g')"


def cap_sql(x: str) -> str:
    """SQL twin of ``text.capitalize`` (title case of the first character)."""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.TITLECASE_SPECIAL.items())
    return f"(CASE substr({x}, 1, 1) {cases} ELSE upper(substr({x}, 1, 1)) END || lower(substr({x}, 2)))"


def last_paren_sql(x: str) -> str:
    return "coalesce(regexp_extract_all(" + x + ", '\\(\\s*[a-zA-Z]\\s*\\)')[-1], '')"


# ---- fixtures: text variants built from documents / conversations
def _choice(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    return d.select("doc_id",
                    F.concat("text", F.lit(" ("), F.char(F.lit(65) + F.col("doc_id") % 5), F.lit(")")).alias("prediction"),
                    F.char(F.lit(65) + F.col("doc_id") % 4).alias("ground_truth"))


_CHOICE_SQL = "SELECT doc_id, text || ' (' || chr(65 + CAST(doc_id % 5 AS INTEGER)) || ')' AS prediction, chr(65 + CAST(doc_id % 4 AS INTEGER)) AS ground_truth FROM ftxt"


@register("t1_normalize_answer", with_("fpair") + f"""
SELECT conv_id, turn, {norm_sql('prediction')} AS norm_prediction, {norm_sql('ground_truth')} AS norm_truth FROM fpair""")
def t1_normalize_answer(spark, sf_dir):
    p = fx.f_pair(spark, sf_dir)
    return p.select("conv_id", "turn", T.normalize_answer("prediction").alias("norm_prediction"),
                    T.normalize_answer("ground_truth").alias("norm_truth"))


@register("t2_last_paren_letter", with_("ftxt", extra={"c": _CHOICE_SQL}) + f"""
SELECT doc_id, {last_paren_sql('prediction')} AS letter FROM c""")
def t2_last_paren_letter(spark, sf_dir):
    return _choice(spark, sf_dir).select("doc_id", T.last_paren_letter("prediction").alias("letter"))


_BRACKET_SRC = "'  ' || text || ' [title] ' || '[note ' || CAST(doc_id AS VARCHAR) || ']' || text || '    '"


@register("t3_clean_brackets", with_("ftxt") + f"""
SELECT doc_id, replace(regexp_replace(replace({strip_sql(_BRACKET_SRC)}, ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS cleaned FROM ftxt""")
def t3_clean_brackets(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    src = F.concat(F.lit("  "), F.col("text"), F.lit(" [title] "), F.lit("[note "),
                   F.col("doc_id").cast("string"), F.lit("]"), F.col("text"), F.lit("    "))
    return d.select("doc_id", T.clean_brackets(src).alias("cleaned"))


_THINK_SRC = "text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Let''s think step by step.' WHEN doc_id % 3 = 1 THEN '  LET''S THINK STEP BY STEP ' ELSE '' END"
_THINK_TASK = "CASE WHEN lang = 'de' THEN 'boolq' ELSE lang END"


def _think_src(d):
    k = F.col("doc_id") % 3
    return F.concat("text", F.when(k == 0, F.lit("\nLet's think step by step."))
                    .when(k == 1, F.lit("  LET'S THINK STEP BY STEP ")).otherwise(F.lit("")))


@register("t4_strip_think_suffix", with_("ftxt", extra={"x": f"SELECT doc_id, {_THINK_SRC} AS q, {_THINK_TASK} AS task FROM ftxt"}) + f"""
SELECT doc_id, CASE WHEN task = 'boolq'
  THEN {strip_sql("regexp_replace(regexp_replace(q, '\\s+', ' ', 'g'), '(?i)\\s*let''?s think step by step\\.?\\s*$', '')")}
  ELSE {strip_sql("regexp_replace(q, '(?i)\\s*let''s think step by step\\.?\\s*$', '')")} END AS normalized_query FROM x""")
def t4_strip_think_suffix(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    task = F.when(F.col("lang") == "de", "boolq").otherwise(F.col("lang"))
    return d.select("doc_id", T.strip_think_suffix(_think_src(d), task).alias("normalized_query"))


@register("t5_remove_think_phrase", with_("ftxt") + f"""
SELECT doc_id, replace(replace({_THINK_SRC.replace("'  LET''S THINK STEP BY STEP '", "' let''s think step by step again'")}, 'let''s think step by step', ''), 'Let''s think step by step', '') AS cleaned FROM ftxt""")
def t5_remove_think_phrase(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    k = F.col("doc_id") % 3
    src = F.concat("text", F.when(k == 0, F.lit("\nLet's think step by step."))
                   .when(k == 1, F.lit(" let's think step by step again")).otherwise(F.lit("")))
    return d.select("doc_id", T.remove_think_phrase(src).alias("cleaned"))


@register("t6_reformat_ground_truth", with_("fpair") + """
SELECT conv_id, turn, CASE WHEN task_name IN ('mbpp', 'human_eval') THEN '[BEGIN]' || chr(10) || ' ' || ground_truth || ' ' || chr(10) || '[DONE]'
  WHEN task_name IN ('mmlu','gpqa','commonsense_qa','openbook_qa','arc_challenge','hellaswag') THEN '(' || ground_truth || ')'
  ELSE ground_truth END AS output FROM fpair""")
def t6_reformat_ground_truth(spark, sf_dir):
    p = fx.f_pair(spark, sf_dir)
    return p.select("conv_id", "turn", T.reformat_ground_truth("ground_truth", "task_name").alias("output"))


@register("t7_index_letter", "SELECT doc_id, chr(65 + CAST(doc_id % 4 AS INTEGER)) AS letter FROM documents")
def t7_index_letter(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    return d.select("doc_id", T.index_to_letter(F.col("doc_id") % 4).alias("letter"))


@register("t8_option_lines", """
SELECT p_partkey, array_to_string(list_transform([p_name, p_brand, p_type], lambda x, i: chr(64 + CAST(i AS INTEGER)) || '. ' || x || chr(10)), '') AS dot_style,
       array_to_string(list_transform([p_name, p_brand, p_type], lambda x, i: chr(10) || '(' || chr(64 + CAST(i AS INTEGER)) || ') ' || x), '') AS paren_style
FROM part""")
def t8_option_lines(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    opts = F.array("p_name", "p_brand", "p_type")
    return p.select("p_partkey", T.option_lines(opts).alias("dot_style"), T.option_lines(opts, style="paren").alias("paren_style"))


_CODE_SRC = """CASE doc_id % 4 WHEN 0 THEN 'Sure. [BEGIN]' || chr(10) || text || chr(10) || '[DONE] more'
  WHEN 1 THEN '[begin] def f(): ' || text || ' [Done]'
  WHEN 2 THEN 'x [BEGIN]' || text || chr(10)
  ELSE '  ' || text || '  ' END"""


def _code_src():
    k = F.col("doc_id") % 4
    return (F.when(k == 0, F.concat(F.lit("Sure. [BEGIN]\n"), F.col("text"), F.lit("\n[DONE] more")))
             .when(k == 1, F.concat(F.lit("[begin] def f(): "), F.col("text"), F.lit(" [Done]")))
             .when(k == 2, F.concat(F.lit("x [BEGIN]"), F.col("text"), F.lit("\n")))
             .otherwise(F.concat(F.lit("  "), F.col("text"), F.lit("  "))))


@register("t16_extract_code", with_("ftxt", extra={"x": f"""
SELECT doc_id, {_CODE_SRC} AS pred FROM ftxt""", "y": f"""
SELECT doc_id, regexp_matches(pred, '(?i)\\[BEGIN\\]') AS has,
       {strip_sql("regexp_extract(pred, '(?is)\\[BEGIN\\](.*?)(?:\\[DONE\\]|$)', 1)")} AS body, pred FROM x"""}) + f"""
SELECT doc_id, CASE WHEN has THEN body ELSE {strip_sql('pred')} END AS code,
  CASE WHEN has AND NOT starts_with(regexp_replace(body, '^\\s+', ''), 'def ') THEN '    ' || replace(body, chr(10), chr(10) || '    ')
       WHEN has THEN body ELSE {strip_sql('pred')} END AS humaneval_code FROM y""")
def t16_extract_code(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    src = _code_src()
    return d.select("doc_id", T.extract_code(src).alias("code"),
                    T.extract_code(src, F.lit(True)).alias("humaneval_code"))


_NUM_TRUTH_SQL = "'work #### ' || CAST(doc_id % 100 AS VARCHAR)"


@register("t17_gsm8k_numbers", with_("ftxt", extra={"x": """
SELECT doc_id, regexp_extract_all(text, '(-?[0-9.,]+)', 1) AS runs, """ + _NUM_TRUTH_SQL + """ AS gt FROM ftxt"""}) + f"""
SELECT doc_id, {strip_sql("translate(coalesce(list_filter(runs, lambda r: r NOT IN ('', '.'))[-1], runs[1]), ',$.', '')")} AS pred_number,
       {strip_sql("translate(string_split(gt, '####')[-1], ',$.', '')")} AS truth_number FROM x""")
def t17_gsm8k_numbers(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    gt = F.concat(F.lit("work #### "), (F.col("doc_id") % 100).cast("string"))
    return d.select("doc_id", T.gsm8k_prediction("text").alias("pred_number"), T.gsm8k_truth(gt).alias("truth_number"))


@register("t18_angle_number", """
SELECT doc_id, CAST(coalesce(regexp_extract(text || ' <' || CAST(doc_id % 7 AS VARCHAR) || '>', '<([0-9]+)>', 1) = CAST(doc_id % 5 AS VARCHAR), false) AS DOUBLE) AS score
FROM documents""")
def t18_angle_number(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    pred = F.concat("text", F.lit(" <"), (F.col("doc_id") % 7).cast("string"), F.lit(">"))
    return d.select("doc_id", S.angle_score(pred, (F.col("doc_id") % 5).cast("string")).alias("score"))


@register("t23_capitalize", f"""
SELECT doc_id, {cap_sql('text')} AS capitalized FROM documents""")
def t23_capitalize(spark, sf_dir):
    d = fx.f_txt(spark, sf_dir)
    return d.select("doc_id", T.capitalize("text").alias("capitalized"))


@register("p12_truncate_chars", """
SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '... [truncated]' ELSE text END AS truncated FROM documents""")
def p12_truncate_chars(spark, sf_dir):
    return fx.f_txt(spark, sf_dir).select("doc_id", T.truncate_chars("text").alias("truncated"))


@register("p12_truncate_tokens", """
SELECT doc_id, CASE WHEN len(t) > 300 THEN array_to_string(t[1:300], ' ') ELSE text END AS truncated
FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents) d""")
def p12_truncate_tokens(spark, sf_dir):
    return fx.f_txt(spark, sf_dir).select("doc_id", T.truncate_tokens("text", 300).alias("truncated"))


@register("t26_concat_fields", "SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS query FROM part")
def t26_concat_fields(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    return p.select("p_partkey", T.concat_fields("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand").alias("query"))


@register("t25_chat_template", """
SELECT conv_id, turn, '<|start_header_id|>system<|end_header_id|>' || chr(10) || 'You are a helpful AI assistant. Please provide clear and accurate responses.'
  || chr(10) || '<|eot_id|>' || chr(10) || '<|start_header_id|>user<|end_header_id|>' || chr(10) || text || chr(10) || '<|eot_id|>' || chr(10)
  || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) AS prompt FROM conversations WHERE role = 'user'""")
def t25_chat_template(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", T.chat_template(F.lit(T.CHAT_SYSTEM), "text").alias("prompt"))


# ---------------------------------------------------------------- scoring
_PAIR_HIT = "fpair_hit"


def _pair_variants(spark, sf_dir):
    p = fx.f_pair(spark, sf_dir)
    hit = p.select("conv_id", "turn", "task_name", "metric", "ground_truth",
                   F.concat(F.lit("The "), F.col("ground_truth"), F.lit(".")).alias("prediction"), F.lit(1).alias("variant"))
    raw = p.select("conv_id", "turn", "task_name", "metric", "ground_truth", "prediction", F.lit(0).alias("variant"))
    return raw.unionByName(hit)


_VARIANTS_SQL = {"v": """
SELECT conv_id, turn, task_name, metric, ground_truth, prediction, 0 AS variant FROM fpair
UNION ALL SELECT conv_id, turn, task_name, metric, ground_truth, 'The ' || ground_truth || '.', 1 FROM fpair"""}


@register("e1_exact_match", with_("fpair", extra=_VARIANTS_SQL) + f"""
SELECT conv_id, turn, variant, CAST({norm_sql('prediction')} = {norm_sql('ground_truth')} AS DOUBLE) AS em FROM v""")
def e1_exact_match(spark, sf_dir):
    v = _pair_variants(spark, sf_dir)
    return v.select("conv_id", "turn", "variant", S.exact_match("prediction", "ground_truth").alias("em"))


@register("e2_choice_match", with_("ftxt", extra={"c": _CHOICE_SQL}) + f"""
SELECT doc_id, CAST(contains(lower({strip_sql(last_paren_sql('prediction'))}), lower({strip_sql('ground_truth')})) AS DOUBLE) AS em_mc FROM c""")
def e2_choice_match(spark, sf_dir):
    c = _choice(spark, sf_dir)
    return c.select("doc_id", S.choice_match("prediction", "ground_truth").alias("em_mc"))


#: F-TXT choices whose letters are written with and without blanks, on both sides.
_STRICT_SQL = {"c": """SELECT doc_id, text || ' (' || CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE '' END || substr('ABCD', CAST(doc_id % 4 + 1 AS INTEGER), 1) || ')' AS prediction,
  'answer: (' || substr('ABCD', CAST(doc_id // 4 % 4 + 1 AS INTEGER), 1) || ')' AS ground_truth FROM ftxt"""}
_STRICT_LETTER = r"coalesce(regexp_extract_all({}, '\([a-zA-Z]\)')[-1], '')"


@register("e2_strict_choice", with_("ftxt", extra=_STRICT_SQL) + f"""
SELECT doc_id, {_STRICT_LETTER.format('prediction')} AS letter, CAST({_STRICT_LETTER.format('prediction')} = {_STRICT_LETTER.format('ground_truth')} AS DOUBLE) AS em_mc FROM c""")
def e2_strict_choice(spark, sf_dir):
    """E2's strict form and T2 without blanks: equal letters, and a letter between blanks is none."""
    letter = lambda i: F.substring(F.lit("ABCD"), (i % 4 + 1).cast("int"), F.lit(1))
    d = fx.f_txt(spark, sf_dir)
    c = d.select("doc_id", F.concat("text", F.lit(" ("), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(""), letter(F.col("doc_id")), F.lit(")")).alias("prediction"),
                 F.concat(F.lit("answer: ("), letter(F.floor(F.col("doc_id") / 4)), F.lit(")")).alias("ground_truth"))
    return c.select("doc_id", T.last_paren_letter("prediction", False).alias("letter"), S.choice_match("prediction", "ground_truth", strict=True).alias("em_mc"))


@register("e3_contains_match", with_("fpair", extra=_VARIANTS_SQL) + f"""
SELECT conv_id, turn, variant, CASE WHEN {norm_sql('prediction')} = {norm_sql('ground_truth')}
  OR contains({norm_sql('prediction')}, {norm_sql('ground_truth')}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cem FROM v""")
def e3_contains_match(spark, sf_dir):
    v = _pair_variants(spark, sf_dir)
    return v.select("conv_id", "turn", "variant", S.contains_match("prediction", "ground_truth").alias("cem"))


def _f1_sql(src: str) -> dict:
    return {"p": f"SELECT conv_id, turn, variant, {tok_sql('prediction')} AS pt, {tok_sql('ground_truth')} AS gtok FROM {src}",
            "pc": "SELECT conv_id, turn, variant, tok, count(*) AS c FROM (SELECT conv_id, turn, variant, unnest(pt) AS tok FROM p) t GROUP BY ALL",
            "gc": "SELECT conv_id, turn, variant, tok, count(*) AS c FROM (SELECT conv_id, turn, variant, unnest(gtok) AS tok FROM p) t GROUP BY ALL",
            "sm": """SELECT pc.conv_id, pc.turn, pc.variant, sum(least(pc.c, gc.c)) AS same FROM pc JOIN gc
                     ON pc.conv_id = gc.conv_id AND pc.turn = gc.turn AND pc.variant = gc.variant AND pc.tok = gc.tok GROUP BY ALL""",
            "f": """SELECT p.conv_id, p.turn, p.variant, array_to_string(pt, ' ') AS pn, array_to_string(gtok, ' ') AS gn,
                      coalesce(sm.same, 0)::DOUBLE AS same, len(pt)::DOUBLE AS lp, len(gtok)::DOUBLE AS lg
                    FROM p LEFT JOIN sm ON p.conv_id = sm.conv_id AND p.turn = sm.turn AND p.variant = sm.variant""",
            "r": """SELECT conv_id, turn, variant,
                      CASE WHEN ((pn IN ('yes','no','noanswer') OR gn IN ('yes','no','noanswer')) AND pn <> gn) OR same = 0 THEN 0.0
                           ELSE 2.0 * (same / lp) * (same / lg) / ((same / lp) + (same / lg)) END AS f1,
                      CASE WHEN ((pn IN ('yes','no','noanswer') OR gn IN ('yes','no','noanswer')) AND pn <> gn) OR same = 0 THEN 0.0 ELSE same / lp END AS precision,
                      CASE WHEN ((pn IN ('yes','no','noanswer') OR gn IN ('yes','no','noanswer')) AND pn <> gn) OR same = 0 THEN 0.0 ELSE same / lg END AS recall
                    FROM f"""}


@register("e5_token_f1", with_("fpair", extra={**_VARIANTS_SQL, **_f1_sql("v")}) + f"""
SELECT conv_id, turn, variant, {R6('f1')} AS f1, {R6('precision')} AS precision, {R6('recall')} AS recall FROM r""")
def e5_token_f1(spark, sf_dir):
    v = _pair_variants(spark, sf_dir)
    f = v.select("conv_id", "turn", "variant", S.token_f1("prediction", "ground_truth").alias("m"))
    return f.select("conv_id", "turn", "variant", r6("m.f1").alias("f1"), r6("m.precision").alias("precision"),
                    r6("m.recall").alias("recall"))


@register("e4_cem_f1", with_("fpair", extra={**_VARIANTS_SQL, **_f1_sql("v")}) + f"""
SELECT v.conv_id, v.turn, v.variant, {R6(f"CASE WHEN {norm_sql('v.prediction')} = {norm_sql('v.ground_truth')} OR contains({norm_sql('v.prediction')}, {norm_sql('v.ground_truth')}) THEN 1.0 ELSE r.f1 END")} AS cemf1
FROM v JOIN r ON v.conv_id = r.conv_id AND v.turn = r.turn AND v.variant = r.variant""")
def e4_cem_f1(spark, sf_dir):
    v = _pair_variants(spark, sf_dir)
    return v.select("conv_id", "turn", "variant", r6(S.cem_f1("prediction", "ground_truth")).alias("cemf1"))


@register("e6_gsm8k_score", with_("ftxt", extra={"x": """
SELECT doc_id, regexp_extract_all(text || CASE doc_id % 4 WHEN 0 THEN ' so $' || CAST(doc_id % 100 AS VARCHAR) || '.' WHEN 1 THEN ' so ' || CAST(doc_id % 100 + 1 AS VARCHAR) ELSE '' END,
         '(-?[0-9.,]+)', 1) AS runs, """ + _NUM_TRUTH_SQL + """ AS gt FROM ftxt""", "y": f"""
SELECT doc_id, {strip_sql("translate(coalesce(list_filter(runs, lambda r: r NOT IN ('', '.'))[-1], runs[1]), ',$.', '')")} AS p,
       {strip_sql("translate(string_split(gt, '####')[-1], ',$.', '')")} AS g FROM x"""}) + """
SELECT doc_id, CASE WHEN p IS NULL THEN 0.0::DOUBLE WHEN p = g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM y""")
def e6_gsm8k_score(spark, sf_dir):
    """Answers that end with the right number, with another one, and texts as they are."""
    d = fx.f_txt(spark, sf_dir)
    n = (F.col("doc_id") % 100).cast("string")
    more = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" so $"), n, F.lit(".")))
            .when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" so "), (F.col("doc_id") % 100 + 1).cast("string"))).otherwise(F.lit("")))
    gt = F.concat(F.lit("work #### "), n)
    return d.withColumn("answer", F.concat("text", more)).select("doc_id", S.gsm8k_score("answer", gt).alias("score"))


@register("p11_category_counts", with_("fpair") + """
SELECT CASE WHEN task_name IN ('gsm8k','math') THEN 'math' WHEN task_name IN ('mbpp','human_eval') THEN 'code'
            WHEN task_name IN ('commonsense_qa','openbook_qa','arc_challenge','hellaswag') THEN 'commonsense'
            WHEN task_name IN ('natural_qa','trivia_qa') THEN 'world_knowledge' WHEN task_name IN ('squad','boolq') THEN 'reading'
            WHEN task_name IN ('mmlu','gpqa') THEN 'popular' END AS category, count(*) AS n FROM fpair GROUP BY 1""")
def p11_category_counts(spark, sf_dir):
    p = fx.f_pair(spark, sf_dir)
    return p.groupBy(S.category_of("task_name").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register("p13_task_id_normalise", with_("fpair") + """
SELECT conv_id, turn, CASE WHEN task_name IN ('mbpp','human_eval') AND NOT starts_with(tid, 'HumanEval')
  THEN CAST(TRY_CAST(regexp_replace(tid, '^\\s+|\\s+$', '', 'g') AS BIGINT) AS VARCHAR) ELSE tid END AS task_id
FROM (SELECT *, CASE WHEN task_name = 'human_eval' AND conv_id % 2 = 0 THEN 'HumanEval/' || CAST(conv_id AS VARCHAR)
                     ELSE ' ' || CAST(conv_id AS VARCHAR) || ' ' END AS tid FROM fpair) t""")
def p13_task_id_normalise(spark, sf_dir):
    p = fx.f_pair(spark, sf_dir)
    tid = F.when((F.col("task_name") == "human_eval") & (F.col("conv_id") % 2 == 0),
                 F.concat(F.lit("HumanEval/"), F.col("conv_id").cast("string"))
                 ).otherwise(F.concat(F.lit(" "), F.col("conv_id").cast("string"), F.lit(" ")))
    return p.select("conv_id", "turn", S.normalize_task_id(tid, "task_name").alias("task_id"))


@register("g14_pass_rate", with_("fcode") + f"""
SELECT task_id, {R6('avg(CAST(passed AS INTEGER))')} AS pass_rate FROM fcode GROUP BY task_id""")
def g14_pass_rate(spark, sf_dir):
    p = S.pass_rate_by(fx.f_code(spark, sf_dir), "task_id")
    return p.select("task_id", r6("pass_rate").alias("pass_rate"))
