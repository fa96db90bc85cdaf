"""Fine-tuning set export: E12 (training set) and E13 (test set); T5 T6 P9 U5.

Per query the reference sorts the candidates (W6), emits one ground-truth
example from the first eligible row, then up to K response examples until
the first zero performance (W7).  Here that is two window passes over rows
partitioned by query (bounded by the catalogue) and one by-name union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions import text as T
from routelake.functions.numeric import as_double
from routelake.operators import ranking as R
from routelake.operators.labels import allow_list

# The instruction text and the default small-model allow-list.
INSTRUCTION = "Answer the following questions as required."
SMALL_MODELS = ["qwen2-7b-instruct", "qwen2.5-7b-instruct", "gemma-7b", "codegemma-7b", "gemma-2-9b-it",
                "llama-3.1-8b-instruct", "granite-3.0-8b-instruct", "llama3-chatqa-1.5-8b",
                "mistral-nemo-12b-instruct", "mistral-7b-instruct-v0.3"]


def with_processed(log: DataFrame) -> DataFrame:
    """P5 on the sort columns (performance, judge, output tokens)."""
    return (log.withColumn("performance_processed", as_double(log, "performance"))
               .withColumn("llm_judge_processed", as_double(log, "llm_judge"))
               .withColumn("output_tokens_num_processed",
                           as_double(log, "output_tokens_num")))


def sft_train_set(log: DataFrame, setting: str = "perf", k: int = 5, small_models: DataFrame | None = None,
                  group: str = "query_id", pos: str = "pos") -> DataFrame:
    """``(query_id, seq, instruction, input, output)``.

    ``seq`` 0 is the ground-truth example, 1..K the response examples in sort
    order.  ``small_models`` (one column ``llm``) restricts the candidates
    (``_think`` variants included).  Setting ``baseline`` emits only the
    ground-truth examples, each replicated K+1 times (P9), with ``copy``.

    One window pass per query (rank and the running count of zero
    performances share one sort), and every row yields its ground-truth
    and/or response example through one ``explode``: a single shuffle and a
    single scan of the log.
    """
    df = with_processed(log)
    if small_models is not None:
        df = allow_list(df, small_models)
    order = R.setting_order(setting, pos)
    w = Window.partitionBy(group).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.when(F.col("performance_processed") == 0, 1).otherwise(0)
    x = df.withColumn("__rank", F.row_number().over(w)).withColumn("__stopped", F.sum(zero).over(run))
    instr = F.lit(INSTRUCTION)
    gt = F.when(F.col("__rank") == 1, F.struct(
        F.lit(0).alias("seq"), instr.alias("instruction"),
        T.remove_think_phrase(F.col("query").cast("string")).alias("input"),
        T.reformat_ground_truth("ground_truth", "task_name").alias("output")))
    if setting == "baseline":
        out = x.where(F.col("__rank") == 1).select(group, gt.alias("e"))
        return (out.select(group, "e.*")
                   .select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("copy")))
    resp = F.when((F.col("__stopped") == 0) & (F.col("__rank") <= k), F.struct(
        F.col("__rank").alias("seq"), instr.alias("instruction"),
        F.col("query").cast("string").alias("input"), F.col("response").cast("string").alias("output")))
    keep = (F.col("__rank") == 1) | ((F.col("__stopped") == 0) & (F.col("__rank") <= k))
    out = x.where(keep).select(group, F.explode(F.filter(F.array(gt, resp), lambda e: e.isNotNull())).alias("e"))
    return out.select(group, "e.*")


def sft_test_set(log: DataFrame, mode: str = "query", size: int = 40, group: str = "query_id",
                 pos: str = "pos", by: str = "split") -> DataFrame:
    """One example per query (``mode='query'``) or per complete positional
    chunk of ``size`` rows (``mode='positional'``), ground truth as output."""
    if mode == "query":
        first = R.first_per_group(log, group, pos)
        key = F.col(group)
    else:
        c = R.chunk_by_position(log, size, by, group, pos, keep_partial=False)
        w = Window.partitionBy(by, "chunk").orderBy("position")
        first = c.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")
        key = F.col("chunk")
    return first.select(key.alias("example_id"), F.lit(INSTRUCTION).alias("instruction"),
                        F.col("query").cast("string").alias("input"),
                        F.col("ground_truth").cast("string").alias("output"))


def small_model_table(spark, names=None) -> DataFrame:
    """The allow-list as a one-column DataFrame (``llm``)."""
    return spark.createDataFrame([(n,) for n in (names or SMALL_MODELS)], "llm string")
