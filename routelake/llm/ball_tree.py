"""Exact top-k inner-product search with ball trees.

Rows are dealt into shards of bounded size. A shard's ball tree is searched by branch and bound for a block of queries at a
time: nodes in descending order of the upper bound centre.q + radius * |q|, and not at all when the bound
can't reach the kth score. A first pass searches one shard for every query; its kth score is shared with the second
pass over all other shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.llm.common import group_bounds, whole_groups, written

SCALE = 1024
LEAF = 64
SHARD_ROWS = 4096       # rows of a shard: one ball tree, held by one task
QUERY_BLOCK = 256       # queries that visit a shard together
LANE_BLOCKS = 32        # query blocks that one task takes to a shard; further lanes build its tree again
_EXACT = 2.0 ** 53


def _ints(col) -> np.ndarray:
    return np.array(col.to_pylist(), dtype=np.float64)


class BallTree:
    """Nodes over rows in a permuted order: centre, radius, smallest id, row range, children."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        self.ids, self.vectors, self.copies, self.nodes = ids, vectors, copies, []
        self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        v = self.vectors[rows]
        centre = v.mean(axis=0)
        far = ((v - centre) ** 2).sum(axis=1)
        node = [centre, float(np.sqrt(far.max())) * (1 + 1e-9) + 1e-6, int(self.ids[rows].min()), rows, None]
        k = len(self.nodes)
        self.nodes.append(node)
        if len(rows) > LEAF and far.max() > 0:
            a = v[int(far.argmax())]
            b = v[int(((v - a) ** 2).sum(axis=1).argmax())]
            side = v @ (b - a)
            order = np.argsort(side, kind="stable")
            half = len(rows) // 2
            node[4] = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        return k

    def search(self, q: np.ndarray, query_id: int, k: int, floor: float) -> list[tuple[int, int]]:
        """Up to k best (score, id) with a score of at least ``floor``, ties to the smaller id, a row that stands for several as often; not
        the query's own id."""
        norm = float(np.sqrt((q * q).sum())) * (1 + 1e-9)

        def bound(n: int) -> float:
            c, r = self.nodes[n][0], self.nodes[n][1]
            x = float(c @ q) + r * norm
            return x + abs(x) * 1e-9 + 1e-6

        heap, best = [(-bound(0), self.nodes[0][2], 0)], []
        while heap:
            b, least, n = heapq.heappop(heap)
            worst = best[-1][0] if len(best) == k else None
            if -b < floor or worst is not None and -b < worst:
                break
            if worst is not None and -b < worst + 1 and least > best[-1][1]:
                continue  # scores are integers: at most equal to the kth, and every id is larger
            rows, children = self.nodes[n][3], self.nodes[n][4]
            if children:
                for c in children:
                    heapq.heappush(heap, (-bound(c), self.nodes[c][2], c))
                continue
            for s, i, c in zip(self._scores(rows, q), self.ids[rows].tolist(), self.copies[rows].tolist()):
                if s >= floor and i != query_id and (len(best) < k or (-s, i) < (-best[-1][0], best[-1][1])):
                    best += [(s, i)] * min(c, k)
                    best.sort(key=lambda x: (-x[0], x[1]))
                    del best[k:]
        return best

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> list[int]:
        v = self.vectors[rows]
        if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < _EXACT:
            return np.rint(v @ q).astype(np.int64).tolist()
        return [sum(int(a) * int(b) for a, b in zip(x, q)) for x in v]  # beyond exact doubles


_GROUP = ["shard", "lane", "block"]


def _visit(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, lane, block: block -1 are the shard's vectors, the others its query blocks."""
        tree, at = None, None
        for t in whole_groups(batches, _GROUP):
            bounds, out = group_bounds(t, _GROUP), []
            shard, lane, block, ids, copies = (t.column(c).to_numpy() for c in (*_GROUP, "id", "copies"))
            for s, e in zip(bounds[:-1], bounds[1:]):
                v = _ints(t.column("v").slice(s, e - s))
                if block[s] < 0:
                    tree, at = BallTree(ids[s:e], v, copies[s:e]), (shard[s], lane[s])
                elif at == (shard[s], lane[s]):
                    floors = t.column("floor").slice(s, e - s).to_pylist()
                    for q, i, f in zip(v, ids[s:e].tolist(), floors):
                        out += [(i, r, min(max(score, -2**63), 2**63 - 1)) for score, r in tree.search(q, i, k, -np.inf if f is None else f)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    return run


def _searched(vectors: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    lanes = F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / LANE_BLOCKS).cast("int")))
    trees = vectors.select("shard", lanes.alias("lane"), F.lit(-1).alias("block"), "id", "v", "copies", F.lit(None).cast("double").alias("floor"))
    both = trees.unionByName(visits.select("shard", F.floor(F.col("block") / LANE_BLOCKS).cast("int").alias("lane"), "block", "id", "v", "copies", "floor"))
    return both.repartition(*_GROUP[:2]).sortWithinPartitions(*_GROUP).mapInArrow(_visit(k), "query_id long, vec_id long, score long")


def _floored(x):
    """floor(SCALE * x) as a double; doubles from 2^53 on are whole already (and may be no longs)."""
    y = x * SCALE
    return F.when(F.abs(y) < F.lit(_EXACT), F.floor(y).cast("double")).otherwise(y)


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """For every row of ``vectors(vec_id, embedding)`` that satisfies the Column ``is_query``: its k rows of highest integer
    inner product (query_id, rank, vec_id, score), over floor(1024 * x) of each component, ties to the smaller vec_id.

    Queries visit shards in blocks of ``QUERY_BLOCK``; every shard is searched for every query block. Defined cases: a null vec_id, a null vector, and
    a vector with null or non-finite components take no part; only vectors of the query's length are compared; a
    query's own vec_id is no candidate; every other row is one, so rows that repeat a vec_id are listed as often as they occur, while a
    query that is repeated is asked once (with several vectors, once with each: the best of all are its result); an empty table gives an
    empty result; a score beyond 64 bits shows as the largest or smallest long. Other columns are ignored."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(x == x, F.lit(False)) & ~x.isin(float("inf"), float("-inf")) & ~F.isnan(x))
    rows = (vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"),
                                                              is_query.alias("is_query"))
            .where(good)
            .select("id", F.transform("embedding", _floored).alias("v"), F.coalesce("is_query", F.lit(False)).alias("is_query"), F.size("embedding").alias("dim")))
    rows = written(rows.groupBy("id", "v", "is_query", "dim").agg(F.count(F.lit(1)).alias("copies")), "vectors")  # a repeated vector is one row, however often
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {r["dim"]: r["n"] for r in rows.where("is_query").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    spec = rows.sparkSession.createDataFrame([(d, -(-n // SHARD_ROWS), -(-blocks.get(d, 0) // QUERY_BLOCK) or 1) for d, n in counts.items()],
                                             "dim int, shards int, blocks int")
    dealt = rows.join(F.broadcast(spec), "dim").withColumn("s", F.pmod(F.xxhash64("id", F.lit(7)), F.col("shards")).cast("int"))
    shard = lambda s: F.xxhash64("dim", s)  # noqa: E731  a shard's name
    dealt = dealt.withColumn("shard", shard(F.col("s")))
    queries = dealt.where("is_query").withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")).cast("int"))
    first = written(_searched(dealt, queries.withColumn("floor", F.lit(None).cast("double")), k), "first")
    kth = first.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    rest = (queries.join(kth.select(F.col("query_id").alias("id"), "floor"), "id", "left")
            .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("t <> s").withColumn("shard", shard(F.col("t"))))
    found = first.unionByName(_searched(dealt, rest, k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
