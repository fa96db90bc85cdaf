import math
import random

import pytest
from pyspark.sql import functions as F

from routelake.llm import ball_tree
from routelake.llm.ball_tree import top_k


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in good:
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [(r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("shard,block,lanes", [(4096, 256, 32), (100, 2, 1)])
def test_equals_brute_force(spark, monkeypatch, shard, block, lanes):
    for name, x in (("SHARD_ROWS", shard), ("QUERY_BLOCK", block), ("LANE_BLOCKS", lanes)):
        monkeypatch.setattr(ball_tree, name, x)
    rnd = random.Random(1)
    same = [0.25] * 8
    rows = [(i, same if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    rows += [(1000, None), (1001, [None] * 8), (1002, [math.nan] * 8), (1100, [math.inf] * 8), (None, same), (1200, [1.0] * 3), (1201, [2.0] * 3), (1300, []),
             (1400, [3e8] * 8), (1401, [-3e3] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(5)
    got = {}
    for r in sorted(top_k(df, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute(rows)


def test_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0).collect()) == [(0, 1, 1, 1024 * 2048), (0, 2, 1, 1024 * 2048)]
    assert top_k(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("shard", [4096, 3])
def test_repeated_rows_are_listed_as_often_as_they_occur(spark, monkeypatch, shard):
    """Also with a vector that a third of all rows repeat, and a repeated query: what the SQL gives."""
    import duckdb

    from routelake.llm.queries import ORACLES

    monkeypatch.setattr(ball_tree, "SHARD_ROWS", shard)
    rows = [(i, [float(i % 7), 1.0]) for i in range(1, 40)] + [(5, [9.0, 1.0])] * 3 + [(6, [8.0, 1.0])] * 40 + [(100, [1.0, 2.0])] * 2 + [(200, [1.0, 0.0]), (200, [-1.0, 0.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 100 == 0).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [[i, v] for i, v in rows])
    want = sorted((q, int(r), v, s) for q, r, v, s in con.sql(f"SELECT query_id, rank, vec_id, score FROM ({ORACLES['op9_top_k']}) t").fetchall())
    assert got == want and [r[2] for r in got if r[0] == 100].count(5) == 3


def test_huge_components_end_no_job(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [0.0, 1.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 1024 * 1024), (0, 3, 2, -2**63)]
