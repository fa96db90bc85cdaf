"""Router label build (E10) and its parts: P1 P2 P4 P5 W1 W3 G8.

The reference makes four full passes (one per cost/quality scenario) and
slices rows into positional chunks of 40.  Here all scenarios are computed in
one pass: each scenario's score is a column, candidates are grouped once by
``query_id`` (one shuffle), and the first-argmax label per scenario is a
``max_by`` aggregate (partial aggregation happens map-side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelake.functions.numeric import as_double

# cost/quality presets (alpha, beta) and the re-pricing rule.
SCENARIOS = [("performance", 1.0, 0.0), ("balance", 0.5, 0.5), ("cost", 0.2, 0.8)]
JUDGE_SCENARIO = "llm_judge"
REPRICE_PATTERN = "deepseek-r1"
REPRICE_IN, REPRICE_OUT = 0.55, 2.19


def reprice(df: DataFrame, pattern: str = REPRICE_PATTERN,
            in_price: float = REPRICE_IN, out_price: float = REPRICE_OUT) -> DataFrame:
    """Rows whose model name contains ``pattern`` get cost = in*p_in + out*p_out."""
    new_cost = (F.col("input_tokens_num") * F.lit(in_price) + F.col("output_tokens_num") * F.lit(out_price))
    return df.withColumn("cost", F.when(F.col("llm").contains(pattern), new_cost)
                         .otherwise(F.col("cost").cast("double")))


def drop_empty_responses(df: DataFrame, col: str = "response") -> DataFrame:
    """Keep rows whose response is non-null and non-empty."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))


def range_stats(df: DataFrame, cols, by) -> DataFrame:
    """Smallest and largest value of each column per group (``__min_<c>``, ``__max_<c>``): W1's statistics of a log or of a part of it."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(*[f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def merge_range_stats(parts: DataFrame, cols, by) -> DataFrame:
    """``range_stats`` of a whole from those of its parts (a row per group and part): the same numbers as from the rows."""
    by = [by] if isinstance(by, str) else list(by)
    return parts.groupBy(*by).agg(*[f(f"__{n}_{c}").alias(f"__{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def minmax_normalise(df: DataFrame, cols, by, stats: DataFrame | None = None) -> DataFrame:
    """``(x - min) / (max - min)`` per group; a constant group gives NULL.

    Group stats come from a partial+final aggregate (or from ``stats``, kept from earlier: see ``ScoredLog``) and are
    joined back; the stats side has one row per group and is broadcast once its size is
    proven.  This avoids a window partitioned by task (one hot task would land
    in a single task slot) and any shuffle of the log on the task key.
    """
    from routelake.operators.common import broadcast_if_small
    by = [by] if isinstance(by, str) else list(by)
    stats = broadcast_if_small(range_stats(df, cols, by) if stats is None else stats)
    out = df.join(stats, by, "left")
    for c in cols:
        mn, mx = F.col(f"__min_{c}"), F.col(f"__max_{c}")
        out = out.withColumn(f"normalized_{c}", F.try_divide(F.col(c) - mn, mx - mn))
    return out.drop(*[f"__{s}_{c}" for c in cols for s in ("min", "max")])


def router_log(log: DataFrame, output_size: int, by: str = "task_name") -> DataFrame:
    """The graph router's training log: each answer's ``effect`` (its performance) and its ``cost`` for an answer of a fixed number of
    ``output_size`` tokens, scaled to [0, 1] within the task (a task of one cost: NULL). ``log`` has the token count of the prompt and both prices."""
    from routelake.functions.numeric import token_cost

    priced = log.withColumn("cost", token_cost("input_tokens_num", F.lit(output_size), "input_price", "output_price"))
    return (minmax_normalise(priced, ["cost"], by).withColumn("cost", F.col("normalized_cost")).drop("normalized_cost")
            .withColumnRenamed("performance", "effect"))


def reward(perf, cost, alpha: float, beta: float) -> Column:
    """Alpha * performance - beta * cost."""
    p = perf if isinstance(perf, Column) else F.col(perf)
    c = cost if isinstance(cost, Column) else F.col(cost)
    return F.lit(alpha) * p - F.lit(beta) * c


def first_argmax(label, score, pos) -> Column:
    """Label of the first maximal non-null score; first candidate if all NULL."""
    return F.max_by(label, F.struct(F.col(score) if isinstance(score, str) else score,
                                    -(F.col(pos) if isinstance(pos, str) else pos)))


#: What W1 normalises in E10, and within which groups.
NORMALISED, NORMALISED_BY = ["eval_performance", "eval_cost"], ["split", "task_name"]


def eval_columns(log: DataFrame, reprice_pattern: str = REPRICE_PATTERN) -> DataFrame:
    """P2 -> P1 -> P5: the rows that are scored, with ``eval_performance`` and ``eval_cost``; row by row."""
    df = drop_empty_responses(reprice(log, reprice_pattern))
    return (df.withColumn("eval_performance", as_double(df, "performance"))
              .withColumn("eval_cost", as_double(df, "cost")))


def prepare_scores(log: DataFrame, reprice_pattern: str = REPRICE_PATTERN, stats: DataFrame | None = None) -> DataFrame:
    """P2 -> P1 -> P5 -> W1 -> P4 for every scenario (score columns ``score_<name>``); ``stats``: W1's, if they are known already."""
    df = minmax_normalise(eval_columns(log, reprice_pattern), NORMALISED, NORMALISED_BY, stats)
    df = (df.withColumnRenamed("normalized_eval_performance", "normalized_performance")
            .withColumnRenamed("normalized_eval_cost", "normalized_cost"))
    for name, a, b in SCENARIOS:
        df = df.withColumn(f"score_{name}", reward("normalized_performance", "normalized_cost", a, b))
    df = df.withColumn(f"score_{JUDGE_SCENARIO}", as_double(df, "llm_judge"))
    return df


def scenario_names():
    return [s[0] for s in SCENARIOS] + [JUDGE_SCENARIO]


def route_records(log: DataFrame, reprice_pattern: str = REPRICE_PATTERN, stats: DataFrame | None = None) -> DataFrame:
    """One routing record per (scenario, split, query).

    Output: ``scenario, split, query_id, query, candidates array<struct<
    candidate_name, performance, cost, score>>, ground_truth`` (best model).
    Candidates per query are bounded by the model catalogue (40 in the
    reference), so the per-query list is small.
    """
    df = prepare_scores(log, reprice_pattern, stats)
    names = scenario_names()
    weights = {name: (a, b) for name, a, b in SCENARIOS}
    # The scenarios' scores are not shuffled with the candidates: they are P4 of two columns that are.
    cand = F.struct(F.col("pos"), F.col("llm"), F.col("normalized_performance"),
                    F.col("normalized_cost"), F.col(f"score_{JUDGE_SCENARIO}"))
    g = df.groupBy("split", "query_id").agg(
        F.min_by("query", "pos").alias("query"),
        F.array_sort(F.collect_list(cand)).alias("__c"),
        *[first_argmax("llm", f"score_{n}", "pos").alias(f"__best_{n}") for n in names])
    def to_candidate(n):
        def score(x):
            return reward(x["normalized_performance"], x["normalized_cost"], *weights[n]) if n in weights else x[f"score_{n}"]
        return lambda x: F.struct(
            x["llm"].alias("candidate_name"), x["normalized_performance"].alias("performance"),
            x["normalized_cost"].alias("cost"), score(x).alias("score"))

    rows = []
    for n in names:
        cands = F.transform("__c", to_candidate(n))
        rows.append(F.struct(F.lit(n).alias("scenario"), cands.alias("candidates"),
                             F.col(f"__best_{n}").alias("ground_truth")))
    return (g.select("split", "query_id", "query", F.explode(F.array(*rows)).alias("r"))
             .select(F.col("r.scenario").alias("scenario"), "split", "query_id", "query",
                     F.col("r.candidates").alias("candidates"), F.col("r.ground_truth").alias("ground_truth")))


def route_labels(log: DataFrame, reprice_pattern: str = REPRICE_PATTERN, stats: DataFrame | None = None) -> DataFrame:
    """Flat view of E10: best model, its score and the candidate count per record."""
    df = prepare_scores(log, reprice_pattern, stats)
    names = scenario_names()
    g = df.groupBy("split", "query_id").agg(
        F.min_by("query", "pos").alias("query"),
        F.count(F.lit(1)).alias("n_candidates"),
        *[first_argmax(F.struct(F.col("llm"), F.col(f"score_{n}")), f"score_{n}", "pos").alias(f"__b_{n}")
          for n in names])
    rows = [F.struct(F.lit(n).alias("scenario"), F.col(f"__b_{n}.llm").alias("best_llm"),
                     F.col(f"__b_{n}.score_{n}").alias("best_score")) for n in names]
    return (g.select("split", "query_id", "query", "n_candidates", F.explode(F.array(*rows)).alias("r"))
             .select(F.col("r.scenario").alias("scenario"), "split", "query_id", "query", "n_candidates",
                     F.col("r.best_llm").alias("best_llm"), F.round(F.col("r.best_score"), 6).alias("best_score")))


def allow_list(df: DataFrame, models: DataFrame, col: str = "llm", model_col: str = "llm",
               with_think: bool = True) -> DataFrame:
    """Keep rows whose model is in ``models`` (optionally also ``<m>_think``).

    ``models`` is a small dimension; the semi join broadcasts it after a size check.
    """
    from routelake.operators.common import join_dim
    m = models.select(F.col(model_col).alias("__m"))
    if with_think:
        m = m.unionByName(m.select(F.concat("__m", F.lit("_think")).alias("__m")))
    m = m.distinct()
    return join_dim(df, m, F.col(col) == F.col("__m"), "left_semi")
