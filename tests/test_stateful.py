"""Upserts of re-landed results and final windows: late, repeated and replayed batches."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from routelake.session import scratch_path
from routelake.sources.runs import RunStore
from routelake.streaming import stateful as S

SCHEMA = "k bigint, attempt int, v string"


@pytest.fixture
def places(spark):
    run = uuid.uuid4().hex
    return [scratch_path(spark, f"{n}-{run}") for n in ("land", "sink", "ckpt")]


@pytest.mark.parametrize("compact_every", [100, 2])
def test_the_greatest_attempt_counts_in_any_landing_order(spark, places, compact_every):
    land, sink, ck = places
    batches = [[(1, 1, "a"), (2, 1, "b"), (2, 3, "B")], [(1, 2, "A"), (2, 2, "late")], [(1, 1, "again"), (3, 1, "c"), (None, 1, "n")], [(1, 2, "A2"), (2, 1, "b")], [(1, 2, "A2")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(land)
        S.upsert_stream(spark, land, SCHEMA, sink, ck, lambda b: b, "k", "attempt", compact_every=compact_every).awaitTermination()
    got = {(r.k, r.attempt, r.v) for r in S.read_upserts(spark, sink, "k", "attempt").collect()}
    assert got == {(1, 2, "A2"), (2, 3, "B"), (3, 1, "c"), (None, 1, "n")}
    if compact_every == 2:
        assert len(RunStore(spark, sink).parts()) <= 3


def test_many_files_at_once_give_the_batch_result(spark, places):
    land, sink, ck = places
    df = spark.range(2000).select((F.col("id") % 37).alias("k"), (F.col("id") * 7919 % 101).cast("int").alias("attempt"), F.col("id").cast("string").alias("v"))
    df.repartition(6).write.json(land)
    S.upsert_stream(spark, land, SCHEMA, sink, ck, lambda b: b, "k", "attempt", max_files_per_trigger=1, compact_every=3).awaitTermination()
    got = S.read_upserts(spark, sink, "k", "attempt").select("k", "attempt")
    want = df.groupBy("k").agg(F.max("attempt").alias("attempt"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert S.read_upserts(spark, sink + "-none", "k", "attempt") is None


EVENTS = "ts timestamp, task_name string, failed boolean"


def day(n, hour=12):
    return dt.datetime(2024, 1, n, hour)


def land_and_run(spark, places, rows):
    land, sink, ck = places
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(land)
    S.final_windows(spark, land, EVENTS, sink, ck, lambda b: b).awaitTermination()


def windows(spark, places):
    return {(r.kind, r.window_start and r.window_start.day, r.task_name): (r.processed, r.failed) for r in S.read_windows(spark, places[1]).collect()}


def test_windows_are_final_once_and_late_rows_count_apart(spark, places):
    land_and_run(spark, places, [(day(1), "t", True), (day(2), "t", False), (day(2, 1), "u", False)])
    assert windows(spark, places) == {("open", 1, "t"): (1, 1), ("open", 2, "t"): (1, 0), ("open", 2, "u"): (1, 0)}
    land_and_run(spark, places, [(day(1), "t", False), (day(5), "t", False)])  # day 1 is still open for this batch
    assert windows(spark, places) == {("final", 1, "t"): (2, 1), ("final", 2, "t"): (1, 0), ("final", 2, "u"): (1, 0), ("open", 5, "t"): (1, 0)}
    land_and_run(spark, places, [(day(1), "t", True), (day(2), "u", False), (day(4, 23), "t", False), (None, "t", True), (day(5), "t", True)])
    want = {("final", 1, "t"): (2, 1), ("final", 2, "t"): (1, 0), ("final", 2, "u"): (1, 0), ("late", 1, "t"): (1, 1), ("late", 2, "u"): (1, 0), ("late", None, "t"): (1, 1),
            ("open", 4, "t"): (1, 0), ("open", 5, "t"): (2, 1)}
    assert windows(spark, places) == want


def test_a_replayed_batch_counts_once(spark, places, monkeypatch):
    """The batch is committed, then the query dies before Spark notes it; the restarted query gets the same batch again."""
    land_and_run(spark, places, [(day(1), "t", True), (day(9), "t", False)])
    real = RunStore.write_runs

    def dies(self, runs, meta=None):
        real(self, runs, meta)
        raise RuntimeError("died after the commit")

    monkeypatch.setattr(RunStore, "write_runs", dies)
    with pytest.raises(Exception):
        land_and_run(spark, places, [(day(9), "t", True), (day(2), "t", True)])
    monkeypatch.undo()
    land_and_run(spark, places, [(day(9), "u", True)])
    assert windows(spark, places) == {("final", 1, "t"): (1, 1), ("late", 2, "t"): (1, 1), ("open", 9, "t"): (2, 1), ("open", 9, "u"): (1, 1)}
