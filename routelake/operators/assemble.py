"""Log assembly (E11) and its parts: J1 J2 J11 P7 P8 T21, catalogue handling.

The model catalogue is configuration-sized (20 models, 40 with think
variants); ``work_list`` inlines one of that size as a literal array and explodes it, so the
queries x models work list is a single narrow stage: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def work_list(queries: DataFrame, catalogue: DataFrame, max_models: int = 4096) -> DataFrame:
    """Every query paired with every catalogue model.

    A catalogue of at most ``max_models`` rows is inlined as a literal array and each
    query row expands to one row per model: no join, no shuffle.  A larger one is
    paired in blocks of models (``_work_list_by_blocks``); the rows are the same.
    """
    rows = catalogue.limit(max_models + 1).collect()
    if len(rows) > max_models:
        return _work_list_by_blocks(queries, catalogue, max_models)
    fields = catalogue.schema.fieldNames()
    types = {f.name: f.dataType for f in catalogue.schema.fields}
    lits = [F.struct(*[F.lit(r[f]).cast(types[f]).alias(f) for f in fields]) for r in rows]
    if not lits:
        return queries.select("*", *[F.lit(None).cast(types[f]).alias(f) for f in fields]).limit(0)
    return queries.select("*", F.explode(F.array(*lits)).alias("__m")).select(
        *[c for c in queries.columns], *[F.col(f"__m.{f}").alias(f) for f in fields])


def _work_list_by_blocks(queries: DataFrame, catalogue: DataFrame, block_models: int) -> DataFrame:
    """J1 for a catalogue of any size: models gathered into arrays of about
    ``block_models``, queries repeated once per block, joined on the block and a salt
    (so that a block's queries are spread over many tasks), arrays expanded."""
    n = -(-catalogue.count() // block_models)
    salts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    part = lambda df, k: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(k)).cast("int")
    blocks = (catalogue.groupBy(part(catalogue, n).alias("__block"))
              .agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in catalogue.columns])).alias("__models"))
              .withColumn("__salt", every(salts)))
    asked = queries.withColumn("__salt", part(queries, salts)).withColumn("__block", every(n))
    return asked.join(blocks, ["__block", "__salt"]).select(*[F.col(f"`{c}`") for c in queries.columns], F.inline("__models"))


# ---------------------------------------------------------------- catalogue
def catalogue_lookup(df: DataFrame, catalogue: DataFrame, on: str = "llm",
                     max_rows: int = 100_000) -> DataFrame:
    """Attach price/model/feature columns by model name (broadcast after a size check)."""
    from routelake.operators.common import join_dim
    return join_dim(df, catalogue, on, "left")


# ---------------------------------------------------------------- unpivot / first-row
def unpivot_think(df: DataFrame, plain_cols: dict, think_cols: dict, llm: str = "llm") -> DataFrame:
    """One wide row (plain and think results side by side) -> two rows;
    the think row's model name gets the ``_think`` suffix.

    ``plain_cols`` / ``think_cols`` map output names to source columns."""
    names = list(plain_cols)
    plain = F.struct(F.lit(False).alias("is_think"), F.col(llm).alias("__llm"),
                     *[F.col(plain_cols[n]).alias(n) for n in names])
    think = F.struct(F.lit(True).alias("is_think"), F.concat(F.col(llm), F.lit("_think")).alias("__llm"),
                     *[F.col(think_cols[n]).alias(n) for n in names])
    keep = [c for c in df.columns if c not in set(plain_cols.values()) | set(think_cols.values()) | {llm}]
    x = df.select(*keep, F.inline(F.array(plain, think)))
    return x.withColumnRenamed("__llm", llm)


def keep_on_first_row(df: DataFrame, col: str, by: str = "query_id", order: str = "pos") -> DataFrame:
    """P8 (write side): keep ``col`` only on the first row of each group."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn(col, F.when(F.row_number().over(w) == 1, F.col(col)))


def fill_from_first(df: DataFrame, col: str, by: str = "query_id", order: str = "pos") -> DataFrame:
    """P8 (read side): every row of the group reads the group's first non-NULL value."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(col, F.first(col, ignorenulls=True).over(w))


# ---------------------------------------------------------------- E11
def assemble_log(queries: DataFrame, catalogue: DataFrame, respond, embeddings: DataFrame | None = None,
                 max_models: int = 4096, partitions: int | None = None, done: DataFrame | None = None,
                 rounds: int = 0, earlier=None) -> DataFrame:
    """Queries x models (J1) -> plain/think prompts (P7) -> work left (J9) -> model calls
    (B1, B2) -> token estimates (T22), cost (T21), score (E9) -> embeddings (J11).

    ``queries``: query_id, task_name, task_id, task_description, query,
    query_think, ground_truth, metric.  ``catalogue``: llm, llm_idx,
    input_price, output_price, llm_description (base models; think variants
    are the ``_think`` rows).  ``respond(llm, prompt, ground_truth)`` is the
    model call.  ``embeddings``: query_id plus vector columns (J11).
    ``done``: the log of an earlier call; what succeeded there is not called again and
    comes back unchanged.  ``earlier``: the ``KeyedRuns`` (key query_id, llm) of earlier calls; what succeeded in them
    is found by their key filters, without reading runs that can't hold any of the work, and the result holds the new rows
    only, to be written as the next run.  ``rounds``: retry rounds for failed calls (each one's
    rows are checkpointed); by default a failed call stays a row with success = false.
    Narrow queries are spread before they are paired with models, so the work list itself
    (models times larger) is not shuffled; ``partitions`` sets the number of tasks.
    """
    from routelake.functions import text as T
    from routelake.functions.numeric import token_cost
    from routelake.operators.batch import _spread, fan_out, pending_work, retry_rounds
    from routelake.operators.scoring import score_by_metric
    key = ["query_id", "llm"]
    wl = work_list(_spread(queries, partitions), catalogue, max_models)
    wide = wl.withColumn("__llm_base", F.col("llm"))
    long = unpivot_think(wide, {"prompt": "query"}, {"prompt": "query_think"})
    long = long.withColumn("query", F.col("prompt"))
    if done is not None:
        long = pending_work(long, done, key).select(*long.columns)
    if earlier is not None:
        long = earlier.pending(long, "success")[0].select(*long.columns)
    given = ["__llm_base", "prompt", "ground_truth"]
    called = (retry_rounds(long, respond, given, key, rounds, "response", partitions=0) if rounds
              else fan_out(long, respond, given, "response", 0))
    out = (called
           .withColumn("input_tokens_num", T.token_count_estimate("prompt"))
           .withColumn("output_tokens_num", T.token_count_estimate("response"))
           .withColumn("cost", token_cost("input_tokens_num", "output_tokens_num", "input_price", "output_price"))
           .withColumn("performance", F.when(F.col("success"),
                                             score_by_metric("response", "ground_truth", "metric", "task_name")))
           .drop("prompt", "__llm_base"))
    if embeddings is not None:
        out = join_embeddings(out, embeddings)
    if done is not None:
        out = out.unionByName(done.where("success"), allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- adapters
class Shared:
    """A source whose fields lie in the struct column ``at`` of a table that several sources share (see ``adapt_shared``): an adapter makes one
    struct of its row instead of a table."""

    def __init__(self, at: str):
        self.at = at

    def select(self, *cols) -> Column:
        return F.struct(*cols)


def _fields(src):
    """The columns of a source by name."""
    return (lambda name: F.col(f"{src.at}.{name}")) if isinstance(src, Shared) else F.col


def adapt_shared(df: DataFrame, sources: dict) -> DataFrame:
    """U3 of sources that read the same table: ``sources[name] = (fields, adapter)``, the fields being columns of ``df``. The table is read once, and the
    rows that adapters make of one of its rows follow one another, not a table apart: what is written compresses a text that all of them repeat
    within the same block. A row at a time is built, so no row holds several adapters' texts."""
    kind = F.explode(F.array(*[F.lit(i) for i in range(len(sources))])).alias("__kind")
    each = df.select("*", kind)
    each = each.select("__kind", *[F.struct(*fields).alias(name) for name, (fields, _) in sources.items()])
    row = None
    for i, (name, (_, adapter)) in enumerate(sources.items()):
        made = adapter(Shared(name))
        row = F.when(F.col("__kind") == i, made) if row is None else row.when(F.col("__kind") == i, made)
    return each.select(row.alias("__row")).select("__row.*")


def _query_row(task: str, df: DataFrame | Shared, id_col: str, query, query_think, gt, metric: str,
               task_id=None) -> DataFrame | Column:
    from routelake.functions.prompts import TASK_DESCRIPTIONS
    return df.select(
        _fields(df)(id_col).cast("string").alias("source_id"), F.lit(task).alias("task_name"),
        F.lit(TASK_DESCRIPTIONS[task]).alias("task_description"),
        (task_id if task_id is not None else F.lit(None)).cast("string").alias("task_id"),
        query.alias("query"), query_think.alias("query_think"), gt.cast("string").alias("ground_truth"),
        F.lit(metric).alias("metric"))


def _think(c):
    from routelake.functions.prompts import THINK
    return F.concat(c, F.lit("\n" + THINK))


def adapt_natural_qa(src: DataFrame | Shared, id_col: str = "id") -> DataFrame | Column:
    """A1: question (+ think line), first golden answer."""
    c = _fields(src)
    q = c("question")
    return _query_row("natural_qa", src, id_col, q, _think(q), F.element_at(c("golden_answers"), 1), "cem")


def adapt_trivia_qa(src: DataFrame | Shared, id_col: str = "id") -> DataFrame | Column:
    """A2: question, first normalized alias."""
    c = _fields(src)
    q = c("question")
    return _query_row("trivia_qa", src, id_col, q, _think(q),
                      F.element_at(c("answer.normalized_aliases"), 1), "cem")


def adapt_squad(src: DataFrame | Shared, id_col: str = "id") -> DataFrame | Column:
    """A3: context prompt, first answer text."""
    from routelake.functions import prompts as P
    c = _fields(src)
    return _query_row("squad", src, id_col, P.qa_prompt(c("context"), c("question")),
                      P.qa_prompt(c("context"), c("question"), True), F.element_at(c("answers.text"), 1), "cem")


def adapt_boolq(src: DataFrame | Shared, id_col: str = "id") -> DataFrame | Column:
    """A4: true/false prompt; truth is Python ``str(bool)`` (True/False)."""
    from routelake.functions import prompts as P
    c = _fields(src)
    gt = F.when(c("answer"), F.lit("True")).when(~c("answer"), F.lit("False"))
    return _query_row("boolq", src, id_col, P.bool_prompt(c("passage"), c("question")),
                      P.bool_prompt(c("passage"), c("question"), True), gt, "cem")


def adapt_mmlu(src: DataFrame, id_col: str = "id") -> DataFrame:
    """A5: four-option prompt, answer index -> letter."""
    from routelake.functions import prompts as P
    from routelake.functions.text import index_to_letter
    q = P.mc_prompt("question", "choices")
    return _query_row("mmlu", src, id_col, q, _think(q), index_to_letter(F.col("answer")), "em_mc")


def adapt_gpqa(src: DataFrame, id_col: str = "id", seed: int = 42, order_key=None) -> DataFrame:
    """The four options in a seeded per-row order; the truth is the
    letter where the correct option landed (D1: computed from the shuffled
    array itself).  ``order_key(id_col, i)`` gives the sort key of option
    ``i`` (default ``xxhash64(seed, id, i)``); ties fall back to ``i``."""
    from routelake.functions import prompts as P
    opts = F.array(F.col("Correct Answer"), F.col("Incorrect Answer 1"), F.col("Incorrect Answer 2"),
                   F.col("Incorrect Answer 3"))
    key = order_key or (lambda ident, i: F.xxhash64(F.lit(seed), ident, i))
    keyed = F.transform(opts, lambda x, i: F.struct(key(F.col(id_col), i).cast("long").alias("k"),
                                                    i.alias("i"), x.alias("x")))
    shuffled = F.array_sort(keyed)
    texts = F.transform(shuffled, lambda e: e["x"])
    pos = F.array_position(F.transform(shuffled, lambda e: e["i"]), F.lit(0))
    q = P.mc_prompt(F.col("Question"), texts)
    return _query_row("gpqa", src, id_col, q, _think(q), F.char(F.lit(64) + pos), "em_mc")


def adapt_mbpp(src: DataFrame, id_col: str = "task_id") -> DataFrame:
    """Code prompt with its tests; truth is the test list (as text)."""
    from routelake.functions import prompts as P
    q = P.mbpp_prompt("text", "test_list")
    return _query_row("mbpp", src, id_col, q, _think(q), F.to_json("test_list"), "code_eval",
                      task_id=F.col("task_id"))


def adapt_human_eval(src: DataFrame, id_col: str = "task_id") -> DataFrame:
    """Completion prompt; truth is the test code."""
    from routelake.functions import prompts as P
    q = P.humaneval_prompt("prompt")
    return _query_row("human_eval", src, id_col, q, _think(q), F.col("test"), "code_eval",
                      task_id=F.col("task_id"))


def adapt_gsm8k(src: DataFrame | Shared, id_col: str = "id") -> DataFrame | Column:
    """Word problem; truth is the full answer (``#### n`` tail)."""
    from routelake.functions import prompts as P
    c = _fields(src)
    return _query_row("gsm8k", src, id_col, P.gsm8k_prompt(c("question")), P.gsm8k_prompt(c("question"), True),
                      c("answer"), "GSM8K")


def adapt_labelled_choice(task: str, src: DataFrame, id_col: str = "id", question: str = "question") -> DataFrame:
    """Labelled options ``(L) text``; truth is answerKey."""
    from routelake.functions import prompts as P
    lab, txt = F.col("choices.label"), F.col("choices.text")
    return _query_row(task, src, id_col, P.choice_prompt(question, lab, txt),
                      P.choice_prompt(question, lab, txt, True), F.col("answerKey"), "em_mc")


def adapt_math(src: DataFrame | Shared, id_col: str = "id") -> DataFrame | Column:
    """Boxed-answer prompt; truth is the full solution."""
    from routelake.functions import prompts as P
    c = _fields(src)
    return _query_row("math", src, id_col, P.math_prompt(c("problem")), P.math_prompt(c("problem"), True),
                      c("solution"), "MATH")


def adapt_hellaswag(src: DataFrame | Shared, id_col: str = "id") -> DataFrame | Column:
    """``activity: ctx_a + ' ' + Capitalized(ctx_b)`` and endings, all
    bracket-cleaned (T3); labels A-D; truth = letter of ``label``."""
    from routelake.functions import prompts as P
    from routelake.functions import text as T
    c = _fields(src)
    ctx = F.concat(c("ctx_a"), F.lit(" "), T.capitalize(c("ctx_b")))
    query = T.clean_brackets(F.concat(c("activity_label"), F.lit(": "), ctx))
    texts = F.transform(c("endings"), lambda e: T.clean_brackets(e))
    labels = F.array(*[F.lit(x) for x in "ABCD"])
    gt = F.char(F.lit(65) + c("label").cast("int"))
    return _query_row("hellaswag", src, id_col, P.hellaswag_prompt(query, labels, texts),
                      P.hellaswag_prompt(query, labels, texts, True), gt, "em_mc")


def unify_config_source(src: DataFrame, task: str, query_fields, gt_field: str, gt_subfield: str | None = None,
                        gt_index: int | None = None, metric: str = "f1_score", id_col: str = "id",
                        task_description: str = "") -> DataFrame:
    """Config-driven unify: query = concat of ``query_fields``; truth is
    ``field``, ``field.subfield`` and/or ``[index]``."""
    gt = F.col(gt_field)
    if gt_subfield:
        gt = gt.getField(gt_subfield)
    if gt_index is not None:
        gt = F.get(gt, F.lit(gt_index))  # NULL beyond the end
    q = F.concat(*[F.col(c).cast("string") for c in query_fields])
    return src.select(F.col(id_col).cast("string").alias("source_id"), F.lit(task).alias("task_name"),
                      F.lit(task_description).alias("task_description"), F.lit(None).cast("string").alias("task_id"),
                      q.alias("query"), q.alias("query_think"), gt.cast("string").alias("ground_truth"),
                      F.lit(metric).alias("metric"))


# The further sources' names, query fields, truth fields and metrics.
SOURCE_SHAPES = {
    "alpaca_data": {"query_fields": ["instruction", "input"], "gt_field": "output", "metric": "f1_score"},
    "GSM8K": {"query_fields": ["instruction", "input"], "gt_field": "answer", "metric": "GSM8K"},
    "multi_news": {"query_fields": ["instruction", "input"], "gt_field": "output", "metric": "f1_score"},
    "SQUAD": {"query_fields": ["question"], "gt_field": "answers", "gt_subfield": "text", "gt_index": 0, "metric": "f1_score"},
}


def unify_sources(frames: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """A15 + U3: the named sources (see ``SOURCE_SHAPES``) in the common query layout."""
    return union_sources(*[unify_config_source(df, name, id_col=id_col, **SOURCE_SHAPES[name]) for name, df in frames.items()])


def join_embeddings(log: DataFrame, embeddings: DataFrame, key: str = "query_id") -> DataFrame:
    """Every log row with its query's vectors (NULL where there are none)."""
    return log.join(embeddings, key, "left")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union of adapter outputs (by name, missing columns NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
