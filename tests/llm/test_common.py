import random

import pyarrow as pa

from routelake.llm.common import components, group_bounds, whole_groups


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_random_graphs(spark):
    rnd = random.Random(3)
    chain = list(range(0, 60))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    edges += [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want)
    assert {r["id"]: r["component"] for r in got} == want


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_whole_groups_never_split_a_group():
    rows = [1] * 5 + [2] + [3] * 9 + [4] * 2
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"k": rows[i:i + size]}) for i in range(0, len(rows), size)]
        tables = [t.column("k").to_pylist() for t in whole_groups(iter(batches), ["k"])]
        assert sum(tables, []) == rows
        assert all(not set(a) & set(b) for a, b in zip(tables, tables[1:]))
    t = pa.table({"k": rows})
    assert group_bounds(t, ["k"]).tolist() == [0, 5, 6, 15, 17]
