"""Thought templates (E14) and few-shot thought prompts.

E14: T4 query key -> G11 group (task, key) -> M6 first k keys per task ->
P3 small models -> W5 two-stage top-n -> T12 request prompt -> B1 generator
-> J12 first row per group joined with the template.

E15: J4 templates of the same task description, else J5 first-word
fallback (a gram index over distinct descriptions) -> J6 top-3 by cosine
(exact tiled kNN per description) -> T13/T14 prompt -> J10 merge back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions import text as T
from routelake.operators import ranking as R
from routelake.operators.common import join_dim
from routelake.operators.labels import allow_list
from routelake.operators.vectors import knn_topk
from routelake.session import stored

# Template-request prompt text.
REQUEST_HEAD = ("Given this question and example solutions, extract a concise thought template that captures the "
                "effective reasoning pattern and can serve as guidance:\n\nQuestion: ")
REQUEST_COUNT = "\n\nHere are {n} high-performing solutions:\n"
REQUEST_TAIL = ("Create a concise and clear thought template (1-5 sentences total) focusing on:\n\n"
                "1. Core Task Summarization: Identify the core problem type and general appraoch needed "
                "(in one very concise sentence)\n"
                "2. Reasoning Step: Give a clear chain of thought that can help model address this problem (1-3 sentences)\n"
                "2. Answer Template: What is the prefered answer format / structure for the given query (1 sentence) \n\n"
                "Your template should be specific enough to guide similar problems but general enough to work across "
                "variations. Use 1-2 sentences for straightforward problems and 3-5 sentences for complex ones.\n\n"
                "Thought Template:")
# Few-shot thought prompt text.
FEWSHOT_HEAD = "Here are some similar questions and guidelines in how to solve them:\n\n"
FEWSHOT_ASK = "Now, please solve the following question:\n\n"
FEWSHOT_TAIL = ("\n\n Use the thought templates above as guidance. Reason step by step. And provide the final answer! "
                "The final answer should be enclosed in <answer> and </answer> tags.")


# ---------------------------------------------------------------- E14
def with_query_key(log: DataFrame, task: str = "task_name", query: str = "query") -> DataFrame:
    """T4 + G11 key: ``normalized_query`` per row (think and plain rows meet)."""
    return log.withColumn("normalized_query", T.strip_think_suffix(F.col(query), F.col(task)))


def best_performers(log: DataFrame, k_queries: int, top_n: int, small_models: DataFrame | None = None,
                    task: str = "task_name") -> DataFrame:
    """M6 -> P3 -> W5: the top-n rows of each selected (task, query key) group."""
    x = with_query_key(log, task)
    x = R.first_k_keys_per_group(x, task, "normalized_query", k_queries)
    if small_models is not None:
        x = allow_list(x, small_models)
    return R.two_stage_top(x, [task, "normalized_query"], top_n)


def request_prompts(best: DataFrame, task: str = "task_name") -> DataFrame:
    """One template-request prompt per (task, query key) from its best rows.

    A group with a NULL response yields a NULL prompt (the reference's call
    fails for it)."""
    g = best.groupBy(task, "normalized_query").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("response").alias("r")))).alias("__b"),
        F.count_if(F.col("response").isNull()).alias("__nulls"))
    sols = F.transform("__b", lambda e, i: F.concat(
        F.lit("Solution "), (i + 1).cast("string"), F.lit(":\n"), T.truncate_chars(e["r"]), F.lit("\n\n")))
    prompt = F.concat(F.lit(REQUEST_HEAD), F.col("normalized_query"),
                      F.replace(F.lit(REQUEST_COUNT), F.lit("{n}"), F.size("__b").cast("string")),
                      F.array_join(sols, ""), F.lit(REQUEST_TAIL))
    return g.select(task, "normalized_query", F.size("__b").alias("n_best"),
                    F.when(F.col("__nulls") == 0, prompt).alias("prompt"))


def template_dataset(log: DataFrame, templates: DataFrame, task: str = "task_name",
                     pos: str = "pos") -> DataFrame:
    """First row of each (task, query key) group joined with its
    successful template (``normalized_query, thought_template, success``)."""
    x = with_query_key(log, task)
    w = Window.partitionBy(task, "normalized_query").orderBy(pos)
    first = x.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")
    ok = templates.where(F.col("success")).select(task, "normalized_query", "thought_template")
    keep = [c for c in ("task_name", "task_id", "task_description", "task_description_embedding", "query",
                        "query_embedding", "ground_truth", "metric") if c in first.columns]
    return first.join(ok, [task, "normalized_query"]).select(*keep, "thought_template")


def thought_templates(log: DataFrame, generate, k_queries: int = 10, top_n: int = 3,
                      small_models: DataFrame | None = None, rounds: int = 1) -> DataFrame:
    """E14 end to end; ``generate(prompt) -> template`` is the pluggable model call."""
    from routelake.operators.batch import retry_rounds
    best = best_performers(log, k_queries, top_n, small_models)
    req = request_prompts(best).where(F.col("prompt").isNotNull())
    tpl = retry_rounds(req, generate, "prompt", ["task_name", "normalized_query"], rounds=rounds,
                       output_col="thought_template")
    return template_dataset(log, tpl)


# ---------------------------------------------------------------- E15
GRAM = 3  # characters of the index's grams; shorter words are looked up by themselves


def _grams(text, size):
    """Distinct substrings of ``size`` characters of a column."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, size))))


def containing(words: DataFrame, texts: DataFrame, word: str, text: str) -> DataFrame:
    """(word, text) for every distinct text that contains the (distinct, lower-case) word, ignoring the text's case.

    An inverted index of the texts' grams answers by equi joins: a word is looked up by the one of its grams that
    the fewest texts hold, and only those texts are searched for the word itself."""
    w = words.select(F.col(word).alias("w")).where(F.col("w") != "").distinct()
    looked = stored(w.select("w", F.explode(_grams(F.col("w"), F.least(F.length("w"), F.lit(GRAM)))).alias("gram")), "word-grams")
    t = texts.select(F.col(text).alias("t")).distinct()
    held = t.select("t", F.explode(F.concat(*[F.coalesce(_grams(F.lower("t"), F.lit(n)), F.array()) for n in range(1, GRAM + 1)])).alias("gram"))
    index = stored(held.join(looked.select("gram").distinct(), "gram", "left_semi"), "gram-index")
    rare = (looked.join(index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
            .groupBy("w").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))  # n = 0: no text holds the word
    found = rare.join(index, "gram").where(F.contains(F.lower("t"), F.col("w")))
    return found.select(F.col("w").alias(word), F.col("t").alias(text))


def description_map(queries: DataFrame, templates: DataFrame, desc: str = "task_description") -> DataFrame:
    """J4 + J5 on distinct descriptions: (query description, template description).

    Exact matches first; a query description with no exact match takes every
    template description containing its first word (lower case, literal), found by a gram index.
    """
    qd = queries.select(F.col(desc).alias("q_desc")).where(F.col("q_desc").isNotNull()).distinct()
    td = stored(templates.select(F.col(desc).alias("t_desc")).where(F.col("t_desc").isNotNull()).distinct(), "descriptions")
    both = stored(qd.join(td, F.col("q_desc") == F.col("t_desc"), "left"), "description-matches")
    exact = both.where(F.col("t_desc").isNotNull())
    fw = both.where(F.col("t_desc").isNull()).select("q_desc", F.element_at(F.split(T.py_strip(F.lower("q_desc")), r"(?U)\s+"), 1).alias("__w"))
    return exact.unionByName(fw.join(containing(fw, td, "__w", "t_desc"), "__w").select("q_desc", "t_desc"))


def templates_per_query(queries: DataFrame, templates: DataFrame, qid: str = "query_id", tid: str = "template_id",
                        desc: str = "task_description") -> DataFrame:
    """How many templates share each query's task description: counted per description first, so queries and templates of a
    description never meet row by row."""
    n = templates.where(F.col(desc).isNotNull()).groupBy(desc).agg(F.count(tid).alias("n_templates"))
    return join_dim(queries.select(qid, desc), n, desc, "left").select(qid, F.coalesce("n_templates", F.lit(0)).cast("bigint").alias("n_templates"))


def thought_prompts(queries: DataFrame, templates: DataFrame, k: int = 3, qid: str = "query_id", tid: str = "template_id",
                    vec: str = "embedding", desc: str = "task_description", searched: tuple[DataFrame, DataFrame] | None = None,
                    carried=("thought_template",), thought=lambda e: e["thought_template"]) -> DataFrame:
    """``queries`` plus ``thought_prompt_all`` and ``similar_queries``
    (NULL where no template matched).  Vectors must be arrays (parse text
    with ``functions.numeric.parse_vector`` first).

    ``searched``: the same rows of both sides with their vectors, if these stand in other tables than the texts (default: ``queries``
    and ``templates`` themselves).  ``thought`` makes a winner's template text of its ``carried`` columns and its ``query``, after the
    shuffles, so that a text derived from another one does not travel beside it."""
    asked, offered = searched or (queries, templates)
    m = description_map(asked, offered, desc)
    t = join_dim(offered, m, F.col(desc) == F.col("t_desc")).select(
        F.col("q_desc").alias("__key"), F.col(tid).alias("__tid"), F.col(vec).alias("__tvec"))
    q = asked.where(F.col(vec).isNotNull()).select(
        F.col(desc).alias("__key"), F.col(qid).alias("__qid"), F.col(vec).alias("__qvec"))
    nb = knn_topk(q, t, k, "__qid", "__qvec", "__tid", "__tvec", key="__key").select("__key", "qid", "iid", "rank")
    # Texts meet the winners by id, once each, and not once per description that leads to them.
    texts = templates.select(F.col(tid).alias("iid"), F.col(desc).alias("__desc"), "query", *carried)
    won = join_dim(nb.join(texts, "iid"), m, (F.col("__key") == F.col("q_desc")) & (F.col("__desc") == F.col("t_desc")))
    g = won.groupBy("qid").agg(F.collect_list(F.struct("rank", "query", *carried)).alias("__top"))
    g = g.select("qid", F.array_sort(F.transform("__top", lambda e: F.struct(
        e["rank"].alias("rank"), e["query"].alias("__tq"), thought(e).alias("__tt")))).alias("__top"))
    parts = F.transform("__top", lambda e, i: F.concat(
        F.lit("Question"), (i + 1).cast("string"), F.lit(": "), e["__tq"], F.lit("\n\n"),
        F.lit("Thought Template "), (i + 1).cast("string"), F.lit(": "), e["__tt"], F.lit("\n\n")))
    res = g.select(F.col("qid").alias(qid), F.array_join(parts, "").alias("__shots"),
                   F.array_join(F.transform("__top", lambda e: e["__tq"]), ", ").alias("similar_queries"))
    out = queries.join(res, qid, "left")
    prompt = F.concat(F.lit(FEWSHOT_HEAD), F.col("__shots"), F.lit(FEWSHOT_ASK), F.col("query"), F.lit(FEWSHOT_TAIL))
    return out.withColumn("thought_prompt_all", F.when(F.col("__shots").isNotNull(), prompt)).drop("__shots")
