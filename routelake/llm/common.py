"""Helpers shared by the training-data operators: written intermediate tables, group-wise Arrow streams,
connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: cuts the lineage, and what
    an executor computed survives its loss."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing will read again."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CACHE_BYTES = 100_000_000  # what a Python worker remembers at most, in all operators together
_ENTRY = 160              # bytes of a dictionary entry with its key's and value's headers
_owned: dict = {}


class Cache(dict):
    """A dictionary of an estimated size of at most ``limit`` bytes. When it is full it keeps what it has (the frequent keys came first), until
    ``STALE`` times as many keys as it holds have been turned away: then the texts have changed, and it starts anew."""

    STALE = 4

    def __init__(self, limit: int = CACHE_BYTES):
        super().__init__()
        self.limit = self.room = limit
        self.turned_away = 0

    def put(self, key, value, size: int) -> None:
        size += _ENTRY
        if size > self.room:
            self.turned_away += 1
            if self.turned_away <= self.STALE * len(self) or size > self.limit:
                return
            self.clear()
            self.room, self.turned_away = self.limit, 0
        self[key] = value
        self.room -= size


def worker_state(key, make: Callable):
    """What an operator keeps in a Python worker between tasks (a coder, its caches). Workers are reused from stage to stage, so
    only one operator's state lives at a time: asking for another one drops it and gives its memory back."""
    if key not in _owned:
        if _owned:
            _owned.clear()
            release_memory()
        _owned[key] = make()
    return _owned[key]


def release_memory() -> None:
    """Returns freed memory to the system, as far as the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Re-cut a stream that is sorted by ``keys`` so that no group spans two of the yielded tables.

    A table holds one input batch plus at most one unfinished group, so memory follows the largest group,
    which every caller bounds by its tile size."""
    carry: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        first, end = tuple(c[0] for c in cols), tuple(c[-1] for c in cols)
        changed = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            changed[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(changed)
        if carry and first != last:
            yield pa.Table.from_batches(carry)
            carry = []
        if len(cuts):
            yield pa.Table.from_batches([*carry, b.slice(0, cuts[-1])])
            carry = [b.slice(cuts[-1])]
        else:
            carry.append(b)
        last = end
    if carry:
        yield pa.Table.from_batches(carry)


def group_bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Start offsets of the groups of a table sorted by ``keys``, with the row count appended."""
    changed = np.ones(t.num_rows, dtype=bool)
    if t.num_rows:
        changed[1:] = False
    for k in keys:
        c = t.column(k).to_numpy()
        changed[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(changed), t.num_rows)


class UnionFind:
    """Union-find over the ids one task has seen; ``union`` tells whether the edge joined two sets."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        p = self.parent.setdefault(x, x)
        while p != x:
            g = self.parent[p]
            self.parent[x] = g
            x, p = p, g
        return x

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def tiled(df: DataFrame, n: str, member: str, tile: int) -> DataFrame:
    """Deal the members of a group of ``n`` rows over ceil(n / tile) tiles and repeat each row for every pair of
    tiles it takes part in (columns ``ti`` <= ``tj``, ``own``): all pairs of a group meet, at most 2 * tile
    rows are together, and a group of up to ``tile`` rows is not repeated at all."""
    nt = F.ceil(F.col(n) / F.lit(float(tile))).cast("int")
    own = F.pmod(F.xxhash64(F.col(member)), F.col("nt")).cast("int")
    return (df.withColumn("nt", nt).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
            .withColumn("ti", F.least("own", "other")).withColumn("tj", F.greatest("own", "other"))
            .drop("nt", "other"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs, not null): one row (id, component) per vertex, the
    component being its smallest vertex id.

    Each round hooks every vertex to its smallest neighbour and contracts the edges, until none is left. A vertex
    may be hooked in several rounds (if others were hooked to it); every pointer leads to a smaller vertex of the same
    component, so one of them is enough. The pointers form a forest that pointer doubling then flattens. Every round is written to the shared folder; the driver
    sees only counts."""
    spark = edges.sparkSession
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    vertices = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    hooked = None
    while True:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")),
                                              F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.*")
        least = both.groupBy("id").agg(F.min("to").alias("to"))
        hook = written(least.where("to < id"), "hook")
        hooked = hook if hooked is None else hooked.unionByName(hook)
        ha, hb = hook.select(F.col("id").alias("a"), F.col("to").alias("pa")), hook.select(F.col("id").alias("b"), F.col("to").alias("pb"))
        contracted = (edges.join(ha, "a", "left").join(hb, "b", "left")
                      .select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
                      .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        edges = written(contracted, "edges")
        if edges.isEmpty():
            break
    pointers = written(hooked.groupBy("id").agg(F.min("to").alias("to")), "pointers")
    while True:
        up = pointers.select(F.col("id").alias("to"), F.col("to").alias("up"))
        step = written(pointers.join(up, "to", "left").select("id", F.coalesce("up", "to").alias("to"),
                                                               F.col("up").isNotNull().alias("moved")), "pointers")
        pointers = step.select("id", "to")
        if step.where("moved").isEmpty():
            break
    return vertices.join(pointers, "id", "left").select("id", F.coalesce("to", "id").alias("component"))
