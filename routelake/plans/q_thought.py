"""Registered queries: thought templates (E14 and parts) and thought prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelake.functions.numeric import parse_vector
from routelake.operators import thought as TH
from routelake.operators.common import join_dim
from routelake.plans import fixtures as fx
from routelake.plans.fixtures_sql import with_
from routelake.plans.registry import register
from routelake.plans.q_text import strip_sql


def lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- E14
def _log_gpos(spark, sf_dir):
    """F-LOG with a global row order (query_id, pos) -> pos, as a file row order."""
    f = fx.f_log_once(spark, sf_dir)
    return f.withColumn("pos", F.col("query_id") * 100 + F.col("pos"))


def _small(spark, sf_dir):
    return fx.table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 3 == 0).select(F.col("n_name").alias("llm"))


_NQ_SQL = ("CASE WHEN task_name = 'boolq' THEN " +
           strip_sql("regexp_replace(regexp_replace(query, '\\s+', ' ', 'g'), '(?i)\\s*let''?s think step by step\\.?\\s*$', '')") +
           " ELSE " + strip_sql("regexp_replace(query, '(?i)\\s*let''s think step by step\\.?\\s*$', '')") + " END")

_E14_CTES = {
    "x": f"SELECT * REPLACE (query_id * 100 + pos AS pos), {_NQ_SQL} AS nq FROM flog",
    "sel": """SELECT task_name, nq FROM (SELECT task_name, nq, row_number() OVER (PARTITION BY task_name ORDER BY nq) AS rn
              FROM (SELECT DISTINCT task_name, nq FROM x) d) t WHERE rn <= 5""",
    "xs": """SELECT x.* FROM x JOIN sel ON x.task_name = sel.task_name AND x.nq = sel.nq
             WHERE llm IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL
                           SELECT n_name || '_think' FROM nation WHERE n_nationkey % 3 = 0)""",
    "s1": """SELECT *, row_number() OVER (PARTITION BY task_name, nq ORDER BY performance DESC NULLS LAST, cost ASC NULLS LAST, pos) AS r1 FROM xs""",
    "b": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_name, nq ORDER BY llm_judge DESC NULLS LAST, cost ASC NULLS LAST, r1) AS rank
             FROM s1 WHERE r1 <= 5) t WHERE rank <= 3""",
}


@register("w5_e14_best_performers", with_("flog", extra=_E14_CTES) + """
SELECT task_name, nq AS normalized_query, llm, CAST(rank AS INTEGER) AS rank FROM b""")
def w5_e14_best_performers(spark, sf_dir):
    b = TH.best_performers(_log_gpos(spark, sf_dir), 5, 3, _small(spark, sf_dir))
    return b.select("task_name", "normalized_query", "llm", "rank")


@register("e14_template_prompts", with_("flog", extra=_E14_CTES) + f"""
SELECT task_name, nq AS normalized_query, CAST(count(*) AS INTEGER) AS n_best,
  {lit_sql(TH.REQUEST_HEAD)} || nq || chr(10) || chr(10) || 'Here are ' || CAST(count(*) AS VARCHAR) || ' high-performing solutions:' || chr(10)
  || string_agg('Solution ' || CAST(rank AS VARCHAR) || ':' || chr(10)
       || CASE WHEN length(response) > 1000 THEN substr(response, 1, 1000) || '... [truncated]' ELSE response END
       || chr(10) || chr(10), '' ORDER BY rank)
  || {lit_sql(TH.REQUEST_TAIL)} AS prompt
FROM b GROUP BY task_name, nq""")
def e14_template_prompts(spark, sf_dir):
    b = TH.best_performers(_log_gpos(spark, sf_dir), 5, 3, _small(spark, sf_dir))
    return TH.request_prompts(b)


@register("g11_query_groups", with_("flog", extra={"x": _E14_CTES["x"]}) + """
SELECT task_name, nq AS normalized_query, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries FROM x GROUP BY task_name, nq""")
def g11_query_groups(spark, sf_dir):
    x = TH.with_query_key(fx.f_log(spark, sf_dir))
    return x.groupBy("task_name", "normalized_query").agg(F.count(F.lit(1)).alias("n_rows"),
                                                         F.countDistinct("query_id").alias("n_queries"))


def fake_template(prompt: str) -> str:
    """Deterministic stand-in for the template model: the first line of
    solution 1."""
    lines = prompt.split("\n")
    i = lines.index("Solution 1:") if "Solution 1:" in lines else -1
    return "Template: " + (lines[i + 1] if 0 <= i < len(lines) - 1 else "")


_E14_DATASET_SQL = with_("flog", extra={**_E14_CTES, "t": """
SELECT task_name, nq, 'Template: ' || string_split(CASE WHEN length(response) > 1000 THEN substr(response, 1, 1000) || '... [truncated]' ELSE response END, chr(10))[1] AS thought_template FROM b WHERE rank = 1""", "f": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_name, nq ORDER BY pos) AS rn FROM x) y WHERE rn = 1"""}) + """
SELECT f.task_name, f.query, f.ground_truth, t.thought_template FROM f JOIN t ON f.task_name = t.task_name AND f.nq = t.nq"""


@register("e14_template_dataset", _E14_DATASET_SQL)
def e14_template_dataset(spark, sf_dir):
    """E14 end to end with a deterministic generator standing in for the model."""
    out = TH.thought_templates(_log_gpos(spark, sf_dir), fake_template, k_queries=5, top_n=3,
                               small_models=_small(spark, sf_dir))
    return out.select("task_name", "query", "ground_truth", "thought_template")


@register("g10_templates_per_task", with_("flog", extra=_E14_CTES) + """
SELECT task_name, count(DISTINCT nq) AS n_templates FROM b GROUP BY task_name""")
def g10_templates_per_task(spark, sf_dir):
    """Queries per task after the success filter."""
    out = TH.thought_templates(_log_gpos(spark, sf_dir), fake_template, k_queries=5, top_n=3,
                               small_models=_small(spark, sf_dir))
    return out.groupBy("task_name").agg(F.count(F.lit(1)).alias("n_templates"))


# ---------------------------------------------------------------- E15
VECTOR_IDS = 2_000_000  # ids of vectors that a join of texts may broadcast


def thought_corpus(spark, sf_dir, texts: bool = False):
    """Every document with a vector (vectors repeat over the documents) and a task description: with its vector, or instead with its
    text (``texts``), which is then joined to the vectors' ids only and not shuffled where these are few."""
    v = fx.f_vec(spark, sf_dir).select(F.col("vec_id").alias("vec"), "embedding")
    vec = F.pmod("doc_id", F.lit(v.count()))
    if texts:
        d = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", vec.alias("vec"))
        c = join_dim(d, v.select("vec"), "vec", max_rows=VECTOR_IDS)
    else:
        c = fx.f_txt(spark, sf_dir).select("doc_id", "lang", vec.alias("vec")).join(v, "vec")
    return c.drop("vec").withColumn("task_description", F.concat(F.lit("Group "), F.coalesce("lang", F.lit("unknown")), F.lit(" texts")))


def _e15_sides(c):
    """A fifth of the documents are queries, all others templates. Spanish templates are described in other words, so Spanish queries
    find no template of their description and fall back on those that hold its first word."""
    templates = c.where(F.col("doc_id") % 5 != 0).withColumn(
        "task_description", F.when(F.col("lang") == "es", "Spanish GROUP of texts").otherwise(F.col("task_description")))
    return c.where(F.col("doc_id") % 5 == 0).withColumnRenamed("doc_id", "query_id"), templates.withColumnRenamed("doc_id", "template_id")


def e15_inputs(spark, sf_dir):
    """(queries, templates) with their descriptions and vectors."""
    queries, templates = _e15_sides(thought_corpus(spark, sf_dir))
    # Query vectors arrive as text (as in the reference's CSV) and are parsed once.
    qtext = F.concat(F.lit("tensor("), F.to_json("embedding"), F.lit(", device='cuda:0')"))
    return (queries.select("query_id", "task_description", parse_vector(qtext).alias("embedding")),
            templates.select("template_id", "task_description", "embedding"))


def e15_texts(spark, sf_dir):
    """(queries, templates): the same rows with their texts (``query``) instead of the vectors."""
    queries, templates = _e15_sides(thought_corpus(spark, sf_dir, texts=True))
    return (queries.select("query_id", F.col("text").alias("query"), "task_description"),
            templates.select("template_id", F.col("text").alias("query"), "lang", "task_description"))


def _template(e):
    return F.concat(F.lit("Template: "), F.coalesce(e["lang"], F.lit("unknown")), F.lit(" "), e["query"])


_E15_CTES = {
    "c": """SELECT d.doc_id, d.text, coalesce(d.lang, 'unknown') AS lang, v.embedding, 'Group ' || coalesce(d.lang, 'unknown') || ' texts' AS descr
            FROM ftxt d JOIN fvec v ON d.doc_id % (SELECT count(*) FROM fvec) = v.vec_id""",
    "t": """SELECT doc_id AS tid, text AS tq, CASE WHEN lang = 'es' THEN 'Spanish GROUP of texts' ELSE descr END AS tdesc, embedding AS tvec,
              'Template: ' || lang || ' ' || text AS tt
            FROM c WHERE doc_id % 5 <> 0""",
    "q": "SELECT doc_id AS qid, text AS query, descr AS qdesc, embedding AS qvec FROM c WHERE doc_id % 5 = 0",
    "qd": "SELECT DISTINCT qdesc FROM q", "td": "SELECT DISTINCT tdesc FROM t",
    "m": """SELECT qdesc, tdesc FROM qd JOIN td ON qdesc = tdesc
            UNION ALL
            SELECT qd.qdesc, td.tdesc FROM qd, td WHERE qd.qdesc NOT IN (SELECT tdesc FROM td)
              AND contains(lower(td.tdesc), string_split_regex(trim(lower(qd.qdesc)), '\\s+')[1])""",
    "s": """SELECT q.qid, t.tid, t.tq, t.tt,
              CASE WHEN sqrt(list_dot_product(q.qvec, q.qvec)) * sqrt(list_dot_product(t.tvec, t.tvec)) = 0 THEN 0.0
                   ELSE list_dot_product(q.qvec, t.tvec) / (sqrt(list_dot_product(q.qvec, q.qvec)) * sqrt(list_dot_product(t.tvec, t.tvec))) END AS sim
            FROM q JOIN m ON q.qdesc = m.qdesc JOIN t ON t.tdesc = m.tdesc""",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, tid) AS rn FROM s) x WHERE rn <= 3",
    "agg": """SELECT qid, string_agg('Question' || CAST(rn AS VARCHAR) || ': ' || tq || chr(10) || chr(10) || 'Thought Template '
                || CAST(rn AS VARCHAR) || ': ' || tt || chr(10) || chr(10), '' ORDER BY rn) AS shots,
                string_agg(tq, ', ' ORDER BY rn) AS similar_queries FROM top GROUP BY qid""",
}


@register("e15_thought_prompts", with_("ftxt", "fvec", extra=_E15_CTES) + f"""
SELECT q.qid AS query_id, CASE WHEN agg.shots IS NOT NULL THEN {lit_sql(TH.FEWSHOT_HEAD)} || agg.shots || {lit_sql(TH.FEWSHOT_ASK)}
   || q.query || {lit_sql(TH.FEWSHOT_TAIL)} END AS thought_prompt_all, agg.similar_queries
FROM q LEFT JOIN agg ON q.qid = agg.qid""")
def e15_thought_prompts(spark, sf_dir):
    out = TH.thought_prompts(*e15_texts(spark, sf_dir), k=3, searched=e15_inputs(spark, sf_dir), carried=["lang"], thought=_template)
    return out.select("query_id", "thought_prompt_all", "similar_queries")


@register("j5_description_map", with_("ftxt", "fvec", extra={k: _E15_CTES[k] for k in ("c", "t", "q", "qd", "td", "m")}) + """
SELECT qdesc AS q_desc, tdesc AS t_desc FROM m""")
def j5_description_map(spark, sf_dir):
    queries, templates = e15_inputs(spark, sf_dir)
    return TH.description_map(queries, templates)


@register("t15_parse_vector", """
SELECT vec_id, len(embedding) AS dims, """ + "(round((list_sum(list_transform(embedding, lambda x: x::DOUBLE))) * 1000000.0) / 1000000.0)" + """ AS total
FROM embeddings""")
def t15_parse_vector(spark, sf_dir):
    from routelake.operators.common import r6
    v = fx.f_vec(spark, sf_dir)
    txt = F.concat(F.lit("tensor("), F.to_json("embedding"), F.lit(", device='cuda:0')"))
    p = v.select("vec_id", parse_vector(txt).alias("e"))
    return p.select("vec_id", F.size("e").cast("bigint").alias("dims"),
                    r6(F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@register("j4_same_description_templates", with_("ftxt", "fvec", extra={k: _E15_CTES[k] for k in ("c", "t", "q")}) + """
SELECT q.qid AS query_id, count(t.tid) AS n_templates FROM q LEFT JOIN t ON q.qdesc = t.tdesc GROUP BY q.qid""")
def j4_same_description_templates(spark, sf_dir):
    """Templates sharing the query's task description, counted per query."""
    return TH.templates_per_query(*e15_inputs(spark, sf_dir))


@register("j6_top3_similar_templates", with_("ftxt", "fvec", extra={k: _E15_CTES[k] for k in ("c", "t", "q", "qd", "td", "m", "s", "top")}) + """
SELECT qid AS query_id, tid AS template_id, CAST(rn AS INTEGER) AS rank FROM top""")
def j6_top3_similar_templates(spark, sf_dir):
    """Top-3 templates by cosine within the matched descriptions (exact tiled top-k)."""
    from routelake.operators.vectors import knn_topk
    queries, templates = e15_inputs(spark, sf_dir)
    m = TH.description_map(queries, templates)
    t = join_dim(templates, m, F.col("task_description") == F.col("t_desc")).select(
        F.col("q_desc").alias("__key"), "template_id", "embedding")
    q = queries.select(F.col("task_description").alias("__key"), "query_id", "embedding")
    nb = knn_topk(q, t, 3, "query_id", "embedding", "template_id", "embedding", key="__key")
    return nb.select(F.col("qid").alias("query_id"), F.col("iid").alias("template_id"), "rank")
