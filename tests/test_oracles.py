"""Every registered query against its DuckDB oracle (sf0.001), and the
rows-only queries for a clean run."""

import pytest

import __spark_entry__ as E
from tests.compare import duck, same_result

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, con, name):
    same_result(QUERIES[name](spark, sf_dir), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert len(df.columns) > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["scenario", "split", "query_id", "query", "n_candidates", "best_llm", "best_score"]
