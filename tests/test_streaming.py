"""X1 restarts from its checkpoint: files landed after the first run are
scored by the second, nothing twice, and the result equals batch scoring."""

import uuid

from pyspark.sql import functions as F

from routelake.operators.scoring import score_by_metric
from routelake.plans import fixtures as fx
from routelake.session import scratch_path
from routelake.streaming import incremental as X

SCHEMA = "conv_id bigint, turn bigint, ground_truth string, prediction string, task_name string, metric string"


def test_incremental_scoring_resumes(spark, sf_dir):
    run = uuid.uuid4().hex[:8]
    land, sink, ck = (scratch_path(spark, f"{n}-{run}") for n in ("land", "sink", "ckpt"))
    pairs = fx.f_pair(spark, sf_dir)
    score = lambda b: b.select("conv_id", "turn", score_by_metric("prediction", "ground_truth", "metric",
                                                                  "task_name").alias("score"))
    pairs.where(F.col("conv_id") % 2 == 0).write.json(land)
    X.incremental_scoring(spark, land, SCHEMA, sink, ck, score).awaitTermination()
    first = spark.read.parquet(sink).count()
    pairs.where(F.col("conv_id") % 2 == 1).write.mode("append").json(land)
    X.incremental_scoring(spark, land, SCHEMA, sink, ck, score).awaitTermination()
    got = spark.read.parquet(sink).drop("batch_id")
    want = score(pairs)
    assert 0 < first < got.count()
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_windowed_counts_batch_equals_stream(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("task_name"),
                                                   (F.col("event_type") == "error").alias("failed"))
    batch = X.windowed_counts(ev, watermark="31 days").select(
        F.col("w.start").alias("window_start"), "task_name", "processed", "failed")
    run = uuid.uuid4().hex[:8]
    land, sink, ck = (scratch_path(spark, f"{n}-{run}") for n in ("evland", "evsink", "evckpt"))
    fx.table(spark, sf_dir, "events").repartition(3).write.parquet(land)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    prep = lambda s: s.select("ts", F.col("event_type").alias("task_name"),
                              (F.col("event_type") == "error").alias("failed"))
    X.running_counts(spark, land, schema, sink, ck, prep, watermark="31 days",
                     max_files_per_trigger=1).awaitTermination()
    stream = X.read_running_counts(spark, sink).select("window_start", "task_name", "processed", "failed")
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0
