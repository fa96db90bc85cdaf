"""Readers and writers for the log and its derived sets: S1-S13.

All paths are URIs for the cluster's shared storage (HDFS/S3/...); intermediate
outputs go under ``spark.checkpoint.dir`` (see ``session.scratch_path``).
Writers are distributed (one file per partition, committed by Spark's commit
protocol); nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The multi-model log, as read from CSV.
LOG_SCHEMA = T.StructType([
    T.StructField("task_name", T.StringType()), T.StructField("task_id", T.StringType()),
    T.StructField("task_description", T.StringType()), T.StructField("task_description_embedding", T.StringType()),
    T.StructField("query", T.StringType()), T.StructField("query_embedding", T.StringType()),
    T.StructField("ground_truth", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("llm", T.StringType()), T.StructField("input_price", T.DoubleType()),
    T.StructField("output_price", T.DoubleType()), T.StructField("input_tokens_num", T.LongType()),
    T.StructField("output_tokens_num", T.LongType()), T.StructField("performance", T.StringType()),
    T.StructField("cost", T.DoubleType()), T.StructField("response", T.StringType()),
    T.StructField("llm_description", T.StringType()), T.StructField("llm_judge", T.DoubleType()),
])

CANDIDATE = T.StructType([T.StructField("candidate_name", T.StringType()),
                          T.StructField("performance", T.DoubleType()),
                          T.StructField("cost", T.DoubleType()), T.StructField("score", T.DoubleType())])
ROUTE_SCHEMA = T.StructType([T.StructField("query", T.StringType()),
                             T.StructField("candidates", T.ArrayType(CANDIDATE)),
                             T.StructField("ground_truth", T.StringType())])

MAX_CATALOGUE = 10_000
CATALOGUE_ENTRY = "struct<feature:string,input_price:double,output_price:double,model:string>"


# ---------------------------------------------------------------- CSV
def read_csv(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """Header CSV with quoted multi-line text; explicit schema (no inference)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, every field quoted, ``"`` escaped by doubling."""
    (df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path))


def append_csv(df: DataFrame, path: str) -> None:
    """S3: one distributed append (the reference appends row by row)."""
    write_csv(df, path, mode="append")


# ---------------------------------------------------------------- dispatch
def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reader chosen by suffix (.csv/.json/.parquet); other suffixes raise
    ValueError, a missing path raises FileNotFoundError."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no table at {path}")
    low = path.rstrip("/").lower()
    if low.endswith(".csv"):
        return read_csv(spark, path, schema or LOG_SCHEMA)
    if low.endswith(".json"):
        r = spark.read.option("multiLine", True)
        return (r.schema(schema) if schema else r).json(path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for the suffix of {path}")


# ---------------------------------------------------------------- JSON
def read_route_json(spark: SparkSession, path: str, schema: T.StructType = ROUTE_SCHEMA) -> DataFrame:
    """Files each holding one JSON array of routing records."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def write_json_arrays(df: DataFrame, path: str, chunk_col: str) -> None:
    """S6 (array form): one JSON array file per value of ``chunk_col``.

    Chunks must be bounded (e.g. ``query_id div 200``) because each array is
    built in one task; for one array of any size use ``json_array.write_json_array``."""
    body = df.groupBy(chunk_col).agg(F.to_json(F.collect_list(F.struct(*[c for c in df.columns if c != chunk_col])))
                                     .alias("value"))
    body.write.mode("overwrite").partitionBy(chunk_col).text(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False, gzip: bool = False) -> None:
    """JSON lines, optionally appended and gzip-compressed."""
    w = df.write.mode("append" if append else "overwrite")
    if gzip:
        w = w.option("compression", "gzip")
    w.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, plain or .gz (codec from the file suffix); blank lines skipped."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S9."""
    return spark.read.parquet(path)


# ---------------------------------------------------------------- catalogue
def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{model: {feature, input_price, output_price, model}}``
    -> one row per model with ``llm_idx`` = position in the file."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", f"map<string,{CATALOGUE_ENTRY}>").alias("m"))
    e = m.select(F.posexplode(F.map_entries("m")).alias("llm_idx", "e"))
    return e.select(F.col("e.key").alias("llm"), F.col("llm_idx").cast("int").alias("llm_idx"),
                    F.col("e.value.feature").alias("llm_description"), F.col("e.value.input_price").alias("input_price"),
                    F.col("e.value.output_price").alias("output_price"), F.col("e.value.model").alias("model"))


def write_catalogue(catalogue: DataFrame, path: str, order: str = "llm_idx") -> None:
    """Write a catalogue as a single JSON object, by one task: a row per model, at most ``MAX_CATALOGUE`` (more raise)."""
    from routelake.operators.common import row_count_at_most

    if not row_count_at_most(catalogue, MAX_CATALOGUE):
        raise ValueError(f"a catalogue of more than {MAX_CATALOGUE} models; write it as a table")
    entry = F.struct(F.col("llm_description").alias("feature"), "input_price", "output_price", "model")
    obj = catalogue.agg(F.to_json(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("llm").alias("k"), entry.alias("v")))),
        lambda s: F.struct(s["k"], s["v"])))).alias("value"))
    obj.coalesce(1).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- splits
def split_source(df: DataFrame, split: str, col: str = "split") -> DataFrame:
    """Rows of the named split, else of the first split (smallest name).

    The choice is one scalar aggregate; the filter is then a literal, so it
    prunes partitions when ``split`` is a partition column."""
    row = df.agg(F.max(F.when(F.col(col) == split, F.col(col))).alias("hit"), F.min(col).alias("first")).first()
    chosen = row["hit"] if row["hit"] is not None else row["first"]
    return df.where(F.col(col) == F.lit(chosen))


# ---------------------------------------------------------------- checkpoints
def write_run(df: DataFrame, path: str, run_id) -> None:
    """Append one run as a ``run_id=...`` partition (all of a job's files or none, by
    the output committer; earlier runs are untouched).  Writing a run id again adds to it: for runs that must
    count once, replace one another or survive a replay use ``runs.RunStore``."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest run (partition-pruned by a literal run id)."""
    df = spark.read.parquet(path)
    top = df.agg(F.max("run_id").alias("m")).first()["m"]
    return df.where(F.col("run_id") == F.lit(top))


def latest_per_key(df: DataFrame, key, order=("run_id",)) -> DataFrame:
    """S13 (per key): the newest version of each key (max by ``order``)."""
    key = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*[F.col(o) for o in order])).alias("__r"))
    return best.select(*key, *[F.col(f"__r.{c}").alias(c) for c in others])


def run_summary(df: DataFrame, success: str = "success") -> DataFrame:
    """S13 counts: successful / failed rows of a run."""
    return df.agg(F.count_if(F.col(success)).alias("ok"), F.count_if(~F.col(success)).alias("failed"))
