"""Plan shape assertions: JVM-side expressions on the SQL paths, bounded
broadcasts, partial top-k before the shuffle, no pair-emitting joins."""

import contextlib
import io

import pytest

import __spark_entry__ as E

Q = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["e10_route_labels", "e5_token_f1", "e12_sft_train_perf", "e14_template_prompts",
                                  "w9_w11_ranking_metrics", "e7_math_score", "t1_normalize_answer"])
def test_no_python_on_sql_paths(spark, sf_dir, name):
    p = plan(Q[name](spark, sf_dir))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_e10_single_pass_partial_aggregation(spark, sf_dir):
    p = plan(Q["e10_route_labels"](spark, sf_dir))
    assert "partial_max_by" in p or "partial_" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_topk_is_window_group_limit(spark, sf_dir):
    p = plan(Q["m1_sample_per_task"](spark, sf_dir))
    assert "WindowGroupLimit" in p


def test_dimension_join_is_broadcast(spark, sf_dir):
    p = plan(Q["j2_catalogue_lookup"](spark, sf_dir))
    assert "BroadcastHashJoin" in p


def test_work_list_has_no_join(spark, sf_dir):
    p = plan(Q["j1_work_list"](spark, sf_dir))
    assert "Generate" in p and "Join" not in p


def test_knn_emits_no_pairs(spark, sf_dir):
    p = plan(Q["r1_knn_neighbours"](spark, sf_dir))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    assert "FlatMapCoGroupsInPandas" in p


def test_scan_prunes_columns(spark, sf_dir):
    p = plan(Q["w4_first_per_query"](spark, sf_dir))
    lineitem_schema = [line for line in p.splitlines() if "ReadSchema" in line and "l_partkey" in line]
    assert lineitem_schema and all("l_shipdate" not in line for line in lineitem_schema)


def test_split_and_run_filters_prune_partitions(spark, sf_dir):
    """S11/S13 on a log partitioned by split / run_id: the literal filter
    reaches the scan as a partition filter (only that folder is read)."""
    import uuid

    from pyspark.sql import functions as F

    from routelake.plans import fixtures as fx
    from routelake.session import scratch_path
    from routelake.sources import io as sio

    base = scratch_path(spark, f"partitioned-{uuid.uuid4().hex[:8]}")
    fx.f_log(spark, sf_dir).write.partitionBy("split").parquet(base + "/log")
    p = plan(sio.split_source(spark.read.parquet(base + "/log"), "test"))
    assert "PartitionFilters" in p and "test" in p.split("PartitionFilters")[1].splitlines()[0]
    ev = fx.f_evt(spark, sf_dir).select("event_id", (~F.col("failed")).alias("success"))
    for day in (1, 2):
        sio.write_run(ev, base + "/runs", day)
    p = plan(sio.latest_run(spark, base + "/runs"))
    assert "PartitionFilters" in p and "run_id" in p.split("PartitionFilters")[1].splitlines()[0]
