"""Statistics kept by run: incremental labels equal those of the whole log."""

import uuid

import pytest

from routelake.operators import labels as L
from routelake.operators.scored_log import ScoredLog
from routelake.plans import fixtures as fx
from routelake.session import scratch_path


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture
def log(spark):
    return ScoredLog(spark, scratch_path(spark, f"scored-{uuid.uuid4().hex}"))


def test_incremental_equals_full(spark, sf_dir, log):
    f = fx.f_log_once(spark, sf_dir)
    for k in (0, 1):
        log.write_run(f.where(f"query_id % 3 = {k}"), k)
    log.write_run(f.where("query_id % 3 = 2").selectExpr("* except (cost)", "cost * 9 as cost"), 2)
    log.write_run(f.where("query_id % 3 = 2"), 2)  # the wider range of the first try must not stay
    assert same(log.labels(), L.route_labels(f))
    assert same(log.labels([1]), L.route_labels(f).where("query_id % 3 = 1"))


def test_a_new_day_reads_only_itself(spark, sf_dir, log):
    f = fx.f_log_once(spark, sf_dir)
    for k in range(3):
        log.write_run(f.where(f"query_id % 3 = {k}"), k)
    files = set(log.labels([2]).inputFiles())
    of_runs = [set(log.rows.read([k]).inputFiles()) for k in range(3)]
    assert files & of_runs[2] and not files & (of_runs[0] | of_runs[1])
    assert log.stats().count() <= f.select("split", "task_name").distinct().count()


def test_a_writer_that_dies_between_rows_and_statistics(spark, sf_dir, log, monkeypatch):
    f = fx.f_log_once(spark, sf_dir)
    log.write_run(f, 1)
    monkeypatch.setattr(log.parts, "write_run", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.write_run(f.where("query_id % 2 = 0"), 1)
    monkeypatch.undo()
    assert not log.consistent()
    with pytest.raises(ValueError):
        log.labels()
    log.write_run(f.where("query_id % 2 = 0"), 1)
    assert same(log.labels(), L.route_labels(f.where("query_id % 2 = 0")))
