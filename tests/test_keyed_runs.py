"""Resuming from runs by their key filters: exact results, and runs that are never opened."""

import shutil
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelake.session import scratch_path
from routelake.sources import keyed_runs as K


def test_filters_have_no_false_negatives_and_few_false_positives():
    r = np.random.RandomState(1)
    h = r.randint(-2**63, 2**63 - 1, 20_000, dtype=np.int64)
    f = K.make_filter(h)
    assert K.may_hold(f, h).all() and K.may_hold(f, r.randint(-2**63, 2**63 - 1, 20_000, dtype=np.int64)).mean() < 0.02
    assert len(f) == 25_000 and not K.may_hold(K.make_filter(np.empty(0, np.int64)), h[:50]).any()


@pytest.fixture
def store(spark):
    s = K.KeyedRuns(spark, scratch_path(spark, f"keyed-{uuid.uuid4().hex}"), ["q", "llm"])
    for day in range(4):  # a day's queries have numbers of their own
        s.write_run(spark.range(day * 100, day * 100 + 100).select(F.col("id").alias("q"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("llm"),
                                                                   (F.col("id") % 10 != 0).alias("success")), day)
    return s


def rows(df):
    return sorted((r.q, r.llm) for r in df.collect())


def work(spark, ids, llms="ab"):
    return spark.createDataFrame([(i, m) for i in ids for m in llms], "q long, llm string")


@pytest.mark.parametrize("bucket", [50_000, 7])
def test_equals_an_anti_join_with_the_whole_log(spark, monkeypatch, bucket):
    monkeypatch.setattr(K, "BUCKET_KEYS", bucket)
    s = K.KeyedRuns(spark, scratch_path(spark, f"keyed-{uuid.uuid4().hex}"), ["q", "llm"])
    for day in range(3):
        s.write_run(spark.range(day * 40, day * 40 + 60).select(F.col("id").alias("q"), F.lit("ab"[day % 2]).alias("llm"), (F.col("id") % 7 != 0).alias("success")), day)
    w = work(spark, range(0, 300, 3)).unionByName(spark.createDataFrame([(None, "a"), (3, None)], "q long, llm string"))
    left, _ = s.pending(w, "success")
    want = w.join(s.read().where("success").select("q", "llm"), ["q", "llm"], "left_anti")
    assert left.exceptAll(want).count() == 0 and want.exceptAll(left).count() == 0


def test_runs_without_the_work_are_never_opened(spark, store):
    """Their files are gone, and nothing notices."""
    wanted = store.parts()[2]
    for p in store.parts():
        if p is not wanted and p["folder"] != wanted["folder"]:
            shutil.rmtree(f"{store.path}/{p['folder']}".removeprefix("file:"))
    left, touched = store.pending(work(spark, [200, 201, 299, 5000]), "success")
    assert touched == [wanted["folder"]] and rows(left) == [(200, "a"), (200, "b"), (5000, "a"), (5000, "b")]


def test_filters_skip_runs_that_the_range_does_not(spark):
    s = K.KeyedRuns(spark, scratch_path(spark, f"keyed-{uuid.uuid4().hex}"), "q")
    for k in range(4):  # interleaved: every run spans the whole range
        s.write_run(spark.range(k, 4000, 4).select(F.col("id").alias("q")), k)
    left, touched = s.pending(spark.createDataFrame([(1,), (401,), (3001,)], "q long"))
    run1 = next(p["folder"] for p in s.parts() if p["runs"] == [1])
    assert left.count() == 0 and run1 in touched and len(touched) <= 2


def test_nothing_done_and_nothing_to_do(spark, store):
    new = work(spark, range(9000, 9005))
    left, touched = store.pending(new)
    assert touched == [] and rows(left) == rows(new)
    assert store.pending(new.where("false"))[0].count() == 0
    empty = K.KeyedRuns(spark, store.path + "-none", ["q", "llm"])
    assert empty.pending(new)[0].count() == 10


def test_replaced_and_compacted_runs(spark, store):
    store.write_run(spark.createDataFrame([(100, "a", True)], "q long, llm string, success boolean"), 1)
    store.compact(keep_newest=1)
    left, _ = store.pending(work(spark, [5, 100, 101, 305]), "success")
    assert rows(left) == [(100, "b"), (101, "a"), (101, "b")]


def test_log_assembly_goes_on_from_its_runs(spark):
    """A model is down in the first call; the second calls only what is missing, and of new queries everything."""
    from routelake.operators import assemble as A
    from tests.test_batch import MODEL_SCHEMA, MODELS, QUERIES, QUERY_SCHEMA

    def call(down):
        def respond(llm, prompt, gold):
            if llm == down:
                raise RuntimeError("down")
            return f"{down}: {gold}"

        return respond

    cat = spark.createDataFrame(MODELS, MODEL_SCHEMA)
    log = K.KeyedRuns(spark, scratch_path(spark, f"keyed-{uuid.uuid4().hex}"), ["query_id", "llm"])
    some, every = spark.createDataFrame(QUERIES[:4], QUERY_SCHEMA), spark.createDataFrame(QUERIES, QUERY_SCHEMA)
    log.write_run(A.assemble_log(some, cat, call("m3")), 1)
    log.write_run(A.assemble_log(every, cat, call("none"), earlier=log), 2)
    got = {(r.query_id, r.llm): r.response for r in log.read().where("success").collect()}
    assert len(got) == log.read().where("success").count() == 6 * 5 * 2
    assert all(v == ("none: gold%d" if q > 3 or m.startswith("m3") else "m3: gold%d") % q for (q, m), v in got.items())
    assert A.assemble_log(every, cat, call("x"), earlier=log).count() == 0
