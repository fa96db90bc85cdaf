"""Message rounds against dense matrices."""

import numpy as np
import pytest

from routelake.operators import graph as G


def dense(edges, vecs, rounds, keep):
    ids = sorted(vecs)
    at = {n: i for i, n in enumerate(ids)}
    deg = {}
    for u, v in edges:
        deg["s", u] = deg.get(("s", u), 0) + 1
        deg["d", v] = deg.get(("d", v), 0) + 1
    a = np.zeros((len(ids), len(ids)))
    for u, v in edges:
        if u in at and v in at:
            w = (deg["s", u] * deg["d", v]) ** -0.5
            a[at[v], at[u]] += w
            a[at[u], at[v]] += w
    x = np.array([vecs[n] for n in ids])
    for _ in range(rounds):
        x = keep * x + (1 - keep) * a @ x
    return dict(zip(ids, x))


@pytest.mark.parametrize("hot", [3, 100_000])
@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds_equal_dense_products(spark, rounds, hot):
    """A model that a third of all edges reach, a node without edges, a repeated edge, and edges of unknown nodes."""
    r = np.random.RandomState(2)
    edges = [(q, 100) for q in range(30)] + [(q, 101 + (q * 7) % 5) for q in range(30)] + [(q, 101 + (q * 3) % 5) for q in range(30)] + [(1, 100), (2, 999), (888, 101)]
    vecs = {n: r.randn(4) for n in [*range(30), *range(100, 106), 77]}
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in vecs.items()] + [(78, None)], "node long, vec array<double>")
    out = G.message_rounds(spark.createDataFrame(edges, "src long, dst long").repartition(3), nodes, rounds, 0.3, hot_rows=hot)
    got, want = {x.node: x.vec for x in out.collect()}, dense(edges, vecs, rounds, 0.3)
    assert set(got) == set(want) and all(np.allclose(got[n], want[n]) for n in want)


def test_no_edges(spark):
    nodes = spark.createDataFrame([(1, [2.0, 4.0])], "node long, vec array<double>")
    out = G.message_rounds(spark.createDataFrame([], "src long, dst long"), nodes, 2, 0.5)
    assert [tuple(x) for x in out.collect()] == [(1, [0.5, 1.0])]
