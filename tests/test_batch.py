"""Work lists beyond the literal bound, retries that succeed, log assembly that goes on from an earlier log."""

import os

from pyspark.sql import functions as F

from routelake.operators import assemble as A
from routelake.operators import batch as B

QUERIES = [(i, "natural_qa", None, "d", f"q{i}", f"q{i} think", f"gold{i}", "cem") for i in range(6)]
QUERY_SCHEMA = "query_id long, task_name string, task_id string, task_description string, query string, query_think string, ground_truth string, metric string"
MODELS = [(f"m{i}", i, 0.1, 0.2, "x") for i in range(5)]
MODEL_SCHEMA = "llm string, llm_idx int, input_price double, output_price double, llm_description string"


def test_work_list_in_blocks_equals_the_literal_one(spark):
    q, c = spark.createDataFrame(QUERIES + QUERIES[:1], QUERY_SCHEMA), spark.createDataFrame(MODELS, MODEL_SCHEMA)
    one, blocks = A.work_list(q, c), A.work_list(q, c, max_models=2)
    assert blocks.columns == one.columns
    assert one.count() == 35 and blocks.exceptAll(one).count() == 0 and one.exceptAll(blocks).count() == 0


def _fails_once(folder):
    def call(x):
        mark = os.path.join(folder, x)
        if x.startswith("flaky") and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("try again")
        if x.startswith("bad"):
            raise RuntimeError("never")
        return x.upper()

    return call


def test_retries_call_failed_rows_only(spark, tmp_path):
    rows = [("ok1",), ("ok2",), ("flaky1",), ("flaky2",), ("bad",)]
    sizes = []

    def persist(df, i):
        from routelake.session import cut_lineage
        kept = cut_lineage(df)
        sizes.append(kept.count())
        return kept

    df = spark.createDataFrame(rows, "x string")
    out = B.retry_rounds(df, _fails_once(str(tmp_path)), "x", "x", rounds=3, error_threshold=0.2, persist=persist)
    assert sorted((r.x, r.output, r.success) for r in out.collect()) == [
        ("bad", "", False), ("flaky1", "FLAKY1", True), ("flaky2", "FLAKY2", True), ("ok1", "OK1", True), ("ok2", "OK2", True)]
    assert sizes == [5, 3]  # the second round called the three failed rows; one of five then still failed


def test_log_assembly_resumes(spark, tmp_path):
    q, c = spark.createDataFrame(QUERIES, QUERY_SCHEMA), spark.createDataFrame(MODELS, MODEL_SCHEMA)

    def first(llm, prompt, gold):
        if llm == "m3":
            raise RuntimeError("down")
        return f"first {gold}"

    def second(llm, prompt, gold):
        return f"second {gold}"

    path = str(tmp_path / "log")
    A.assemble_log(q, c, first).write.parquet(path)
    old = spark.read.parquet(path)
    new = A.assemble_log(q, c, second, done=old)
    assert new.columns == old.columns and new.count() == old.count() == 60
    got = {(r.llm, r.response.split(" ")[0], r.success) for r in new.select("llm", "response", "success").distinct().collect()}
    assert {x for x in got if x[0].startswith("m3")} == {("m3", "second", True), ("m3_think", "second", True)}
    assert {x[1] for x in got if not x[0].startswith("m3")} == {"first"}
    vectors = q.select("query_id", F.array(F.lit(1.0), F.col("query_id").cast("double")).alias("vec"))
    with_vectors = A.assemble_log(q, c, second, embeddings=vectors, rounds=1)
    assert with_vectors.where("vec[1] = query_id").count() == 60


def test_fan_out_keeps_the_tasks_of_a_wide_input(spark):
    wide = spark.range(100, numPartitions=9).withColumn("x", F.lit("a"))
    assert B.fan_out(wide, str.upper, "x").rdd.getNumPartitions() == 9
    narrow = spark.range(100, numPartitions=1).withColumn("x", F.lit("a"))
    assert B.fan_out(narrow, str.upper, "x").rdd.getNumPartitions() == 4


def test_shuffle_positions_are_a_permutation(spark):
    from routelake.operators.ranking import seeded_shuffle
    df = spark.range(500)
    a = [r.id for r in seeded_shuffle(df, 7, "id", position="p").orderBy("p").collect()]
    assert a == [r.id for r in seeded_shuffle(df, 7, "id").collect()]
    assert sorted(a) == list(range(500)) and a != sorted(a)
    assert a != [r.id for r in seeded_shuffle(df, 8, "id").collect()]


def test_fan_out_keeps_the_tasks_of_a_scan_joined_to_a_small_aggregate(spark):
    """An exchange below a broadcast, or one with more partitions than the session's, is no reason to shuffle the prompts."""
    wide = spark.range(6400, numPartitions=64).select("id", (F.col("id") % 7).alias("k"), F.lit("a").alias("x"))
    small = wide.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = wide.join(F.broadcast(small), "k")
    assert B.fan_out(joined, str.upper, "x").rdd.getNumPartitions() == 64
    assert B.fan_out(wide.repartition(32), str.upper, "x").rdd.getNumPartitions() == 32
    assert B.batch_infer(wide.repartition(32).union(wide), lambda p: p, "x").rdd.getNumPartitions() == 96
    assert B.fan_out(wide.coalesce(1), str.upper, "x").rdd.getNumPartitions() == 4


def test_planned_tasks_runs_no_shuffle(spark):
    from routelake.operators.common import planned_tasks

    def never(batches):
        raise RuntimeError("ran")

    df = spark.range(10, numPartitions=3).mapInPandas(never, "id long").groupBy("id").count()
    assert planned_tasks(df) == 4
