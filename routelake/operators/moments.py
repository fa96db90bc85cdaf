"""Mergeable second moments of vectors: one scan gives the normal equations of every linear router (R2) and the covariance.

Each task adds up n, sums and the Gram matrix of (1, x) and, per label, the sums of (1, x); the partial sums are merged by matrix
row in two levels, so no group holds more than a row per task. What reaches the driver is the finished matrix
(length + 1 squared) and a vector per label, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from routelake.operators.vectors import _usable

MERGE = 64  # partial sums of this many groups of tasks are merged first


class Moments:
    """n, Gram matrix of (1, x) and, by label, sums of (1, x): all plain sums, so moments add up."""

    def __init__(self, gram: np.ndarray, labels: dict[str, np.ndarray]):
        self.gram, self.labels = gram, labels

    @property
    def n(self) -> float:
        return float(self.gram[0, 0])

    @property
    def mean(self) -> np.ndarray:
        return self.gram[0, 1:] / self.n

    def covariance(self) -> np.ndarray:
        """Sample covariance (divided by n - 1; zero for a single row)."""
        centred = self.gram[1:, 1:] - self.n * np.outer(self.mean, self.mean)
        return centred / max(self.n - 1, 1.0)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[int, np.ndarray] = {}
    labels: dict[tuple, np.ndarray] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 2_000):
            b = whole.slice(at, 2_000)
            dims = b.column("dim").to_numpy()
            names = np.array(b.column("label").to_pylist(), dtype=object)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                flat = np.asarray(b.column("vec").take(pa.array(rows)).flatten(), dtype=np.float64).reshape(len(rows), d)
                x = np.hstack([np.ones((len(rows), 1)), flat])
                grams[d] = grams.get(d, 0.0) + x.T @ x
                mine = names[rows]
                for name in {n for n in mine if n is not None}:
                    labels[d, name] = labels.get((d, name), 0.0) + x[mine == name].sum(axis=0)
    part = TaskContext.get().partitionId() % MERGE
    rows = [(int(d), f"g{i:09d}", part, r) for d, g in grams.items() for i, r in enumerate(g)] + [(int(d), f"l{n}", part, r) for (d, n), r in labels.items()]
    for at in range(0, len(rows), 1_000):
        some = rows[at:at + 1_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some]), pa.array([r[2] for r in some], pa.int32()),
                                          pa.array([r[3].tobytes() for r in some], pa.binary())], names=["dim", "entry", "part", "sums"])


def _merged(keys: list[str]):
    def run(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in t.column("sums").to_pylist()], axis=0)
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), pa.array([total.tobytes()], pa.binary())], names=[*keys, "sums"])

    return run


def moments(df: DataFrame, vec: str, label: str | None = None) -> Moments | None:
    """Moments of ``df``'s vectors of the most common length (the shorter on a tie); NULL vectors and those with NULL or NaN components
    don't count, a NULL label counts in the Gram matrix only. None without vectors."""
    name = F.col(label).cast("string") if label else F.lit(None).cast("string")
    rows = df.select(F.col(vec).cast("array<double>").alias("vec"), name.alias("label")).where(_usable("vec")).withColumn("dim", F.size("vec"))
    parts = rows.mapInArrow(_partials, "dim int, entry string, part int, sums binary")
    some = parts.groupBy("dim", "entry", "part").applyInArrow(_merged(["dim", "entry", "part"]), "dim int, entry string, part int, sums binary")
    found = some.groupBy("dim", "entry").applyInArrow(_merged(["dim", "entry"]), "dim int, entry string, sums binary").collect()
    if not found:
        return None
    first = {r["dim"]: np.frombuffer(r["sums"])[0] for r in found if r["entry"] == "g000000000"}
    dim = min(first, key=lambda d: (-first[d], d))
    mine = sorted((r["entry"], np.frombuffer(bytes(r["sums"]))) for r in found if r["dim"] == dim)
    return Moments(np.array([v for k, v in mine if k[0] == "g"]), {k[1:]: v for k, v in mine if k[0] == "l"})


def linear_weights(m: Moments, labels, ridge: float) -> dict[str, np.ndarray]:
    """(intercept, weights) per label of the least squares fit of "has this label" (0 / 1) with a penalty ridge * n on the
    squared weights (not on the intercept): one solve for all labels."""
    penalty = ridge * m.n * np.eye(len(m.gram))
    penalty[0, 0] = 0.0
    names = list(labels)
    right = np.array([m.labels.get(k, np.zeros(len(m.gram))) for k in names]).T
    return dict(zip(names, np.linalg.solve(m.gram + penalty, right).T)) if names else {}


class Components:
    """Principal components (rows) with their variances, largest first; each one's entry of largest absolute value is positive (the first
    one on a tie), so the result doesn't depend on the solver."""

    def __init__(self, m: Moments, k: int):
        values, vectors = np.linalg.eigh(m.covariance())
        order = np.argsort(-values, kind="stable")[:k]
        rows = vectors.T[order]
        lead = np.argmax(np.round(np.abs(rows), 12), axis=1)
        self.mean = m.mean
        self.rows = rows * np.where(rows[np.arange(len(rows)), lead] < 0, -1.0, 1.0)[:, None]
        self.variances = np.maximum(values[order], 0.0)
        self.total = float(np.maximum(values, 0.0).sum())


def project(df: DataFrame, vec: str, components: Components, out: str) -> DataFrame:
    """Adds column ``out``: the centred vector in the components' coordinates; NULL for vectors that are NULL, of another length, or hold
    NULL or NaN."""
    shared = df.sparkSession.sparkContext.broadcast((components.mean, components.rows))
    cols = df.columns
    free = next(n for n in (f"_vec{i}" for i in range(len(cols) + 1)) if n not in cols)
    src = df.withColumn(free, F.when(_usable(vec) & (F.size(vec) == len(components.mean)), F.col(vec).cast("array<double>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rows = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                v = b.column(len(cols))
                x = np.asarray(v.flatten(), dtype=np.float64).reshape(-1, len(mean))
                y = iter(((x - mean) @ rows.T).tolist())
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), pa.array([next(y) if ok else None for ok in v.is_valid().to_pylist()],
                                                                                                  pa.list_(pa.float64()))], names=[*cols, out])

    return src.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))
