"""Resumable batch jobs around a pluggable per-row function: B1-B6, G7, J9, T10.

The remote model call of the reference is the user's function.  Spark
partitions the rows, ``mapInPandas`` runs the function over Arrow batches
inside executors, and each row gets a ``success`` flag instead of failing the
task.  Retries re-run only the failed rows; every round's output is written
to the shared checkpoint folder (or ``checkpoint()``ed), so a lost executor
recomputes from the last written round, not from the first call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from routelake.functions import text as T
from routelake.functions.numeric import judge_score
from routelake.operators.common import spread_if_narrow
from routelake.session import cut_lineage


def fan_out(df: DataFrame, fn: Callable[..., str], input_col, output_col: str = "output",
            partitions: int | None = None) -> DataFrame:
    """B1: apply ``fn`` to the value(s) of ``input_col`` (a name or a list of
    names, passed positionally); an exception gives an empty output and
    ``success = False``.

    ``partitions`` sets the parallelism of the calls (the reference's
    thread-pool size).  By default an input that is planned with fewer tasks than
    ``spark.sql.shuffle.partitions`` is spread round-robin first (deterministic
    on retry: Spark sorts before a round-robin repartition), so expensive
    calls don't pile up in the few tasks of a small input; any other one, shuffled or
    not, keeps its tasks and is not shuffled again.  ``0`` keeps the input partitioning."""
    cols = [input_col] if isinstance(input_col, str) else list(input_col)
    schema = StructType(df.schema.fields + [StructField(output_col, StringType()),
                                            StructField("success", BooleanType())])

    def call(vals):
        try:
            r = fn(*vals)
            return ("" if r is None else str(r)), True
        except Exception:  # noqa: BLE001 - a failed call is data, not a task failure
            return "", False

    def run(batches):
        for pdf in batches:
            res = [call(v) for v in zip(*[pdf[c].tolist() for c in cols])]
            pdf[output_col] = [r[0] for r in res]
            pdf["success"] = [r[1] for r in res]
            yield pdf

    return _spread(df, partitions).mapInPandas(run, schema)


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    if partitions == 0:
        return df
    return df.repartition(partitions) if partitions else spread_if_narrow(df)


def batch_infer(df: DataFrame, fn: Callable[[list], list], input_col: str, output_col: str = "output",
                batch_size: int = 2048, partitions: int | None = None) -> DataFrame:
    """Batched local inference; ``fn`` maps a list of prompts to a list of
    outputs, called on slices of ``batch_size`` rows of each Arrow batch.
    Rows are spread over ``partitions`` tasks first (see ``fan_out``)."""
    schema = StructType(df.schema.fields + [StructField(output_col, StringType())])

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                part[output_col] = [str(x) for x in fn(part[input_col].tolist())]
                yield part

    return _spread(df, partitions).mapInPandas(run, schema)


def chat_prompts(df: DataFrame, query_col: str = "query", system: str = T.CHAT_SYSTEM) -> DataFrame:
    """T25 prompts for B6."""
    return df.withColumn("prompt", T.chat_template(F.lit(system), query_col))


def failure_stats(results: DataFrame, success: str = "success", by=None) -> DataFrame:
    """Processed, failed and error rate (overall or per group)."""
    aggs = [F.count(F.lit(1)).alias("processed"), F.count_if(~F.col(success)).alias("failed"),
            F.avg((~F.col(success)).cast("double")).alias("error_rate")]
    if by is None:
        return results.agg(*aggs)
    by = [by] if isinstance(by, str) else list(by)
    return results.groupBy(*by).agg(*aggs)


def pending_work(work: DataFrame, done: DataFrame, key, success: str = "success",
                 retry_failed: bool = False, order=None) -> DataFrame:
    """Work still to do.  Default: drop keys already finished successfully
    (anti join).  ``retry_failed``: only keys whose newest attempt by the ``order``
    columns failed (semi join); without ``order``, keys that never succeeded."""
    key = [key] if isinstance(key, str) else list(key)
    if retry_failed:
        ok = F.col(success)
        newest = F.max_by(ok, F.struct(*([order] if isinstance(order, str) else order))) if order is not None else F.max(ok)
        last = done.groupBy(*key).agg(newest.alias("__ok"))
        return work.join(last.where(~F.col("__ok")).select(*key), key, "left_semi")
    return work.join(done.where(F.col(success)).select(*key), key, "left_anti")


def retry_rounds(df: DataFrame, fn, input_col: str, key, rounds: int = 3, output_col: str = "output",
                 error_threshold: float = 0.0, persist: Callable[[DataFrame, int], DataFrame] | None = None,
                 partitions: int | None = None, attempt_col: str | None = None) -> DataFrame:
    """First pass, then up to ``rounds`` retries of failed rows only.

    Stops when the share of all rows that still fail is at most
    ``error_threshold`` (0 = no failures).  Each round materialises only the rows
    it called by ``persist`` (default: a reliable ``checkpoint()`` in the shared
    checkpoint folder), so a finished row is written once, and the result is
    the union of what each round finished and what the last one left failed.
    With ``attempt_col`` a row carries the number of its last attempt (0: first pass), which ``fn`` also gets as its
    last argument (another seed, a longer time limit).  The loop itself is a few driver-side control steps over counts, never over rows.
    """
    keep = persist or (lambda d, i: cut_lineage(d))
    given = [input_col] if isinstance(input_col, str) else list(input_col)

    def call(rows: DataFrame, i: int, partitions: int | None = None) -> DataFrame:
        if attempt_col is None:
            return keep(fan_out(rows, fn, given, output_col, partitions), i)
        return keep(fan_out(rows.withColumn(attempt_col, F.lit(i)), fn, [*given, attempt_col], output_col, partitions), i)

    res = call(df, 0, partitions)
    st = failure_stats(res).first()
    total, failing, finished = st["processed"], st["failed"] or 0, []
    for i in range(1, rounds + 1):
        if total == 0 or failing / total <= error_threshold:
            break
        finished.append(res.where(F.col("success")))
        failed = res.where(~F.col("success")).drop(output_col, "success")
        res = call(failed, i)
        failing = failure_stats(res).first()["failed"] or 0
    for part in finished:
        res = res.unionByName(part)
    return res


# The judge rubric prompt.
JUDGE_HEAD = ("You are an expert judge evaluating the quality of an AI model's response. Please score the response "
              "based on the following criteria:\n\n"
              "1. Correctness (0-1): Is the answer correct according to the ground truth?\n"
              "2. Thought Process (0-1): Does the response show clear reasoning and explanation?\n"
              "3. Training Data Quality (0-1): Is the response well-structured and suitable for supervised fine-tuning?\n\n")
JUDGE_TAIL = ("\n\nPlease provide a single score from 0 to 1, where:\n"
              "- 0: Incorrect answer\n"
              "- 0.3: Correct answer but minimal thought process\n"
              "- 0.6: Correct answer with some thought process\n"
              "- 0.8: Correct answer with good thought process\n"
              "- 1.0: Correct answer with excellent thought process and well-suited for training\n\n"
              "Return the score in the following format:\n<answer>SCORE</answer>\n"
              "where SCORE is a number between 0 and 1.")


def judge_prompt(query="query", ground_truth="ground_truth", response="response"):
    """The judge rubric around (query, ground truth, response)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit(JUDGE_HEAD + "Query: "), c(query).cast("string"), F.lit("\nGround Truth: "),
                    c(ground_truth).cast("string"), F.lit("\nResponse: "), c(response).cast("string"), F.lit(JUDGE_TAIL))


def judge_job(log: DataFrame, fn, key, rounds: int = 1, existing: str = "llm_judge") -> DataFrame:
    """T10 prompt -> B1 call (+ B4 second pass) -> T11 parse -> J10 merge.

    Rows that already have a judge score keep it (only NULL rows are sent);
    a reply that cannot be parsed leaves the score NULL (D4: NULL until scored).
    """
    key = [key] if isinstance(key, str) else list(key)
    todo = log.where(F.col(existing).isNull()) if existing in log.columns else log
    req = todo.select(*key, judge_prompt().alias("__prompt"))
    res = retry_rounds(req, fn, "__prompt", key, rounds=rounds, output_col="__reply")
    scored = res.select(*key, judge_score("__reply").alias("__new"))
    out = log.join(scored, key, "left")
    if existing in log.columns:
        return out.withColumn(existing, F.coalesce(F.col("__new"), F.col(existing))).drop("__new")
    return out.withColumnRenamed("__new", existing)


def merge_results(base: DataFrame, new: DataFrame, key, cols) -> DataFrame:
    """Left join results back; new non-NULL values replace old ones."""
    key = [key] if isinstance(key, str) else list(key)
    cols = [cols] if isinstance(cols, str) else list(cols)
    n = new.select(*key, *[F.col(c).alias(f"__new_{c}") for c in cols])
    out = base.join(n, key, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"__new_{c}"), F.col(c)) if c in base.columns
                             else F.col(f"__new_{c}")).drop(f"__new_{c}")
    return out

