"""Resuming a job without reading its old log (J9, E11): runs that carry filters of their keys.

With each run goes a small table: the run's keys are dealt into hash buckets, and of every bucket it keeps a Bloom filter (``BITS`` bits a key) and
the smallest and largest key hash. ``pending`` first drops runs whose range of the first key column can't meet the work, then meets work keys and filters bucket by
bucket; only runs that may hold some of the work are read at all, and only they are compared exactly. A run without any of
the work's keys is (but for a false positive in a hundred keys) never opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.session import stored
from routelake.sources.runs import RunStore

BITS = 10             # bits of a filter per key; with HASHES probes about 1 false positive in 120
HASHES = 7
BUCKET_KEYS = 50_000  # keys of a bucket, about: 62 KB of filter
_U = np.uint64


def _probes(h: np.ndarray, size: int) -> np.ndarray:
    """(keys, HASHES) bit numbers, by double hashing of a 64-bit key hash."""
    x = h.astype(_U)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    step = (x ^ (x >> _U(29))) | _U(1)
    return ((x[:, None] + step[:, None] * np.arange(HASHES, dtype=_U)) >> _U(3)) % _U(size)


def make_filter(h: np.ndarray) -> bytes:
    size = -(-max(64, BITS * len(h)) // 8) * 8
    bits = np.zeros(size, np.uint8)
    bits[_probes(h, size).ravel().astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(filter_: bytes, h: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(filter_, np.uint8)
    at = _probes(h, len(bits) * 8).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7)) & 1).all(axis=1)


def _filters(t: pa.Table) -> pa.Table:
    h = t.column("h").to_numpy()
    return pa.table({"buckets": t.column("buckets").slice(0, 1), "bucket": t.column("bucket").slice(0, 1), "lo": pa.array([int(h.min())]),
                     "hi": pa.array([int(h.max())]), "bits": pa.array([make_filter(h)], pa.binary())})


def _candidates(work: pa.Table, filters: pa.Table) -> pa.Table:
    """Per filter, whether any key of the bucket may be in its run, and which."""
    h = work.column("h").to_numpy()
    keys, parts = [], []
    for part, lo, hi, bits in zip(*(filters.column(c).to_pylist() for c in ("part", "lo", "hi", "bits"))):
        near = h[(h >= lo) & (h <= hi)]
        near = near[may_hold(bits, near)]
        keys.append(near)
        parts += [part] * len(near)
    return pa.table({"h": pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64()), "part": pa.array(parts, pa.string())})


class KeyedRuns(RunStore):
    """A ``RunStore`` whose runs are looked up by ``key`` columns; the first one (a number, date or string) also gives each run a range."""

    def __init__(self, spark, path: str, key):
        super().__init__(spark, path)
        self.key = [key] if isinstance(key, str) else list(key)

    def _hash(self):
        return F.xxhash64(*self.key)

    def stage(self, rows: DataFrame) -> dict:
        part = super().stage(rows)
        data = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{part['folder']}")
        keys = data.select(self._hash().alias("h")).distinct()
        first = F.col(self.key[0])
        lo, hi, n = data.agg(F.min(first).cast("string"), F.max(first).cast("string"), F.approx_count_distinct(self._hash())).first()
        buckets = max(1, -(-n // BUCKET_KEYS))
        name = part["folder"].replace("data/", "filters/", 1)
        dealt = keys.select("h", F.lit(buckets).alias("buckets"), F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"))
        dealt.groupBy("bucket").applyInArrow(_filters, "buckets int, bucket int, lo long, hi long, bits binary").write.parquet(f"{self.path}/{name}")
        return part | {"filter": name, "lo": lo, "hi": hi, "buckets": buckets, "nulls": data.where(first.isNull()).limit(1).count() > 0}

    def vacuum(self) -> list[str]:
        """Also the filters of folders that no version names."""
        gone = super().vacuum()
        live = {p["filter"] for p in self.parts()}
        old = [f"filters/{n}" for n in self._names("filters") if f"filters/{n}" not in live]
        for name in old:
            self._fs().delete(self._hadoop(name), True)
        return gone + old

    def candidates(self, work: DataFrame) -> DataFrame:
        """(h, part): key hashes of ``work`` and the data folders of the runs that may hold them; no run is read."""
        first = self.key[0]
        kind = work.schema[first].dataType
        lo, hi, null = work.agg(F.min(first), F.max(first), F.max(F.col(first).isNull())).first()
        typed = self.spark.createDataFrame([(p["folder"], p["lo"], p["hi"]) for p in self.parts()], "part string, lo string, hi string")
        near = typed.select("part", F.col("lo").cast(kind).alias("lo"), F.col("hi").cast(kind).alias("hi"))
        meets = F.lit(False) if lo is None else (F.col("lo") <= F.lit(hi)) & (F.col("hi") >= F.lit(lo))
        names = {r["part"] for r in near.where(meets).collect()}
        parts = [p for p in self.parts() if p["folder"] in names or (null and p["nulls"])]
        out = None
        for buckets in sorted({p["buckets"] for p in parts}):
            some = [p for p in parts if p["buckets"] == buckets]
            filters = self.spark.read.parquet(*(f"{self.path}/{p['filter']}" for p in some))
            filters = filters.select("bucket", "lo", "hi", "bits", F.concat(F.lit("data/"), F.element_at(F.split(F.input_file_name(), "/"), -2)).alias("part"))
            keys = work.select(self._hash().alias("h")).distinct().withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
            # A bucket's keys come in slices, so a much larger work list than the runs doesn't make a group of its own.
            slices = max(1, -(-keys.count() // (buckets * 20 * BUCKET_KEYS)))
            keys = keys.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(slices)).cast("int"))
            filters = filters.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
            found = keys.groupBy("bucket", "slice").cogroup(filters.groupBy("bucket", "slice")).applyInArrow(_candidates, "h long, part string")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.spark.createDataFrame([], "h long, part string")

    def pending(self, work: DataFrame, finished="true") -> tuple[DataFrame, list[str]]:
        """(the rows of ``work`` whose key no live run has finished, the data folders that had to be read). ``finished`` is a condition on a run's
        rows. Keys with a NULL column are never finished, as in an anti join."""
        maybe = stored(self.candidates(work), "resume-candidates")
        touched = sorted(r["part"] for r in maybe.select("part").distinct().collect())
        if not touched:
            return work, []
        mixed = [p for p in self.parts() if p["folder"] in set(touched)]
        done = self._read(mixed).where(finished).withColumn("__h", self._hash())
        done = done.join(maybe.select(F.col("h").alias("__h")).distinct(), "__h", "left_semi").select(*self.key)
        return work.join(done, self.key, "left_anti"), touched
