"""Committed runs: replays, crashes, concurrent writers, compaction."""

import uuid

import pytest
from pyspark.sql import functions as F

from routelake.session import scratch_path
from routelake.sources import runs
from routelake.sources.runs import RunStore


@pytest.fixture
def store(spark):
    return RunStore(spark, scratch_path(spark, f"runs-{uuid.uuid4().hex}"))


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def got(df):
    return sorted((r.run_id, r.v) for r in df.collect()) if df is not None else []


def test_a_run_written_twice_counts_once(spark, store):
    assert store.read() is None and store.latest() is None and store.version() == 0
    store.write_run(rows(spark, 1, 2), 7)
    store.write_run(rows(spark, 3), 8)
    store.write_run(rows(spark, 1, 2), 7)
    assert got(store.read()) == [(7, 1), (7, 2), (8, 3)]
    store.write_run(rows(spark, 9), 7)
    assert got(store.read()) == [(7, 9), (8, 3)] and got(store.latest()) == [(8, 3)]
    assert got(store.read(version=2)) == [(7, 1), (7, 2), (8, 3)]  # an older reader's view


def test_a_writer_that_dies_leaves_nothing_to_see(spark, store):
    store.write_run(rows(spark, 1), 1)

    def fails(batches):
        for b in batches:
            yield b
            raise RuntimeError("lost")

    with pytest.raises(Exception):
        store.write_run(rows(spark, 5, 6).mapInPandas(fails, "v long"), 2)  # half-written
    part = store.stage(rows(spark, 5).withColumn("run_id", F.lit(3).cast("long")))  # written, not committed
    assert got(store.read()) == [(1, 1)] and store.version() == 1
    gone = store.vacuum()
    assert part["folder"] in gone and len(gone) == 2 and got(store.read()) == [(1, 1)]


def test_of_two_writers_none_is_lost(spark, store, monkeypatch):
    store.write_run(rows(spark, 1), 1)
    real, once = RunStore.state, []

    def late(self, version=None):
        out = real(self, version)
        if not once:  # another writer publishes between this one's reading and publishing
            once.append(1)
            RunStore(spark, self.path).write_run(rows(spark, 2), 2)
        return out

    monkeypatch.setattr(RunStore, "state", late)
    store.write_run(rows(spark, 3), 3)
    monkeypatch.undo()
    assert got(store.read()) == [(1, 1), (2, 2), (3, 3)] and store.version() == 3


def test_giving_up_is_an_error(spark, store, monkeypatch):
    store.write_run(rows(spark, 1), 1)
    monkeypatch.setattr(runs, "RETRIES", 2)
    monkeypatch.setattr(RunStore, "version", lambda self: 0)
    with pytest.raises(runs.Conflict):
        store.write_run(rows(spark, 1), 2)


def test_compaction_keeps_rows_and_later_replacements(spark, store):
    for k in range(5):
        store.write_run(rows(spark, k, 10 + k), k)
    before = got(store.read())
    store.compact(keep_newest=2)
    assert got(store.read()) == before and len(store.parts()) == 3 and len(store.vacuum()) == 3
    store.write_run(rows(spark, 99), 1)  # replaces a run inside the compacted part
    want = sorted([x for x in before if x[0] != 1] + [(1, 99)])
    assert got(store.read()) == want and got(store.read([1, 2])) == [(1, 99), (2, 2), (2, 12)]
    store.compact(keep_newest=0)
    assert got(store.read()) == want and len(store.parts()) == 1 and got(store.latest()) == [(4, 4), (4, 14)]


def test_a_run_replaced_while_others_compact(spark, store, monkeypatch):
    for k in range(3):
        store.write_run(rows(spark, k), k)
    real = RunStore.stage

    def stage(self, df):
        part = real(self, df)
        monkeypatch.undo()
        store.write_run(rows(spark, 77), 0)
        return part

    monkeypatch.setattr(RunStore, "stage", stage)
    store.compact(keep_newest=1)
    assert got(store.read()) == [(0, 77), (1, 1), (2, 2)]


def test_only_the_wanted_run_is_read(spark, store):
    for k in range(4):
        store.write_run(rows(spark, k), k)
    assert len(store.latest().inputFiles()) < len(store.read().inputFiles())
