"""Vector operators: exact top-k cosine neighbours (R1, J6), centroids.

Exact top-k without emitting all pairs: queries are hashed into T tiles and
items into B blocks (bounded cells, and at least as many as the cluster runs tasks).  Each (key, tile, block) cell is a cogroup evaluated with numpy
matrix products over slices of its queries inside ``applyInPandas``; it emits at most k candidates
per query, and a ``row_number() <= k`` window (WindowGroupLimit) merges the
B partial lists.  Spark shuffles and schedules the cells; no pair rows are
ever materialised, and no side is collected to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE_ROWS = 2_000      # queries per cell
BLOCK_ROWS = 8_000     # items per cell
SLICE_ROWS = 256       # queries per matrix product inside a cell


def _norms(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the vectors as a matrix."""
    m = np.vstack(vectors) if len(vectors[0]) else np.zeros((len(vectors), 0))
    return np.sqrt((m * m).sum(axis=1)), m


def _slice_topk(S: np.ndarray, iids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest values of each row, ties to the smaller item id."""
    if k < S.shape[1]:
        kth = np.partition(S, S.shape[1] - k, axis=1)[:, S.shape[1] - k]
        row, col = np.nonzero(S >= kth[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(S.shape))
    order = np.lexsort((iids[col], -S[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], col[place < k]


def _local_topk(k: int, key_cols):
    def fn(key, q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        cols = [*key_cols, "qid", "iid", "sim"]
        if q.empty or it.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in cols})
        qv = [np.asarray(v, dtype=np.float64) for v in q["qvec"]]
        iv = [np.asarray(v, dtype=np.float64) for v in it["ivec"]]
        qrows, irows, sims = [], [], []
        # Unequal dimensions are skipped (pairs of different length never match).
        for dim in sorted({len(v) for v in qv}):
            qi = np.array([i for i, v in enumerate(qv) if len(v) == dim])
            ii = np.array([i for i, v in enumerate(iv) if len(v) == dim], dtype=np.int64)
            if not len(ii):
                continue
            inn, items = _norms([iv[i] for i in ii])
            iids = it["iid"].to_numpy()[ii]
            for lo in range(0, len(qi), SLICE_ROWS):
                part = qi[lo:lo + SLICE_ROWS]
                qn, Q = _norms([qv[i] for i in part])
                den = np.outer(qn, inn)
                S = np.divide(Q @ items.T, den, out=np.zeros_like(den), where=den != 0)
                row, col = _slice_topk(S, iids, k)
                qrows.append(part[row])
                irows.append(ii[col])
                sims.append(S[row, col])
        if not qrows:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in cols})
        qrows, irows = np.concatenate(qrows), np.concatenate(irows)
        res = pd.DataFrame({"qid": q["qid"].to_numpy()[qrows],
                            "iid": it["iid"].to_numpy()[irows], "sim": np.concatenate(sims)})
        for c in key_cols:
            res[c] = pd.Series(q[c].to_numpy(dtype=object)[qrows], dtype=object)
        return res[cols]
    return fn


def _usable(vec: str):
    """Vectors without NULL or NaN components; a NULL vector takes no part."""
    return F.col(vec).isNotNull() & F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x))


def knn_topk(queries: DataFrame, items: DataFrame, k: int, qid: str, qvec: str, iid: str, ivec: str,
             key=None, extra_cols=(), tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS,
             exclude_self: bool = False) -> DataFrame:
    """Exact top-``k`` items by cosine similarity for every query row.

    Returns ``(key..., qid, iid, sim, extra..., rank)``; ties break on the
    smaller item id; a zero vector has similarity 0; vectors that are NULL or
    hold NULL or NaN take no part on either side.  Beyond one block of items the search skips cells by
    distance bounds (``knn_join``), with the same result.  ``key`` restricts
    neighbours to items with the same key value (equi join on the key).
    Item ids are unique within a key.
    """
    from routelake.operators.knn_join import join_sides, sides
    key_cols = [] if key is None else ([key] if isinstance(key, str) else list(key))
    # Both sides are materialised once (reliable checkpoint in the shared
    # folder): the counts that size the cells then read the checkpoint, the
    # cogroup does not recompute the inputs, and a lost executor restarts
    # from here.
    both = sides(queries, items, qid, qvec, iid, ivec, key_cols)
    n_q, n_i = both[0].count(), both[1].count()
    B = max(1, math.ceil(n_i / block_rows))
    if B > 1:  # more items than one block: cells that a query can't need are skipped
        top = join_sides(both, k, key_cols, exclude_self, tile_rows=tile_rows, block_rows=block_rows)
        if top is not None:
            return _with_extras(top, items, key_cols, iid, extra_cols)
    q, it = (x.select(*key_cols, i, F.col("vec").alias(v)) for x, i, v in zip(both, ("qid", "iid"), ("qvec", "ivec")))
    T = max(math.ceil(n_q / tile_rows), math.ceil(queries.sparkSession.sparkContext.defaultParallelism / B))
    # Cell numbers have one type on both sides: a cogroup doesn't cast, and a long hashes to another partition than an int.
    q = (q.withColumn("tile", F.pmod(F.xxhash64("qid"), F.lit(T)).cast("int"))
          .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(B - 1)))))
    it = (it.withColumn("block", F.pmod(F.xxhash64("iid"), F.lit(B)).cast("int"))
            .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(T - 1)))))
    kq = k + 1 if exclude_self else k
    qtype = dict(queries.select(F.col(qid).alias("qid")).dtypes)["qid"]
    itype = dict(items.select(F.col(iid).alias("iid")).dtypes)["iid"]
    key_types = [dict(queries.dtypes)[c] for c in key_cols]
    schema = ", ".join([f"`{c}` {t}" for c, t in zip(key_cols, key_types)]
                       + [f"qid {qtype}", f"iid {itype}", "sim double"])
    grp = [*key_cols, "tile", "block"]
    part = (q.groupBy(*grp).cogroup(it.groupBy(*grp))
             .applyInPandas(_local_topk(kq, key_cols), schema))
    if exclude_self:
        part = part.where(F.col("qid") != F.col("iid"))
    w = Window.partitionBy(*key_cols, "qid").orderBy(F.col("sim").desc(), F.col("iid"))
    top = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return _with_extras(top, items, key_cols, iid, extra_cols)


def _with_extras(top: DataFrame, items: DataFrame, key_cols, iid: str, extra_cols) -> DataFrame:
    """The items' ``extra_cols``, joined to the winners: texts never travel through the search."""
    if not extra_cols:
        return top
    top = top.join(items.select(*key_cols, F.col(iid).alias("iid"), *extra_cols), [*key_cols, "iid"])
    return top.select(*key_cols, "qid", "iid", "sim", *extra_cols, "rank")


def elementwise_mean(df: DataFrame, by, vec: str, name: str = "centroid", digits: int | None = None) -> DataFrame:
    """Element-wise mean vector per group (R5 label centroids, H4 aggregation).

    ``posexplode`` + ``groupBy(group, pos).avg`` keeps the work distributed;
    the re-assembled array has one entry per dimension, so the collected list
    per group is bounded by the vector dimension.
    """
    by = [by] if isinstance(by, str) else list(by)
    x = df.select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("__pos", "__v"))
    g = x.groupBy(*by, "__pos").agg(F.avg("__v").alias("__m"))
    m = F.col("__m")
    if digits is not None:
        m = F.round(m * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)
    g = g.select(*by, F.struct(F.col("__pos"), m.alias("v")).alias("__e"))
    return g.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("__e")), lambda e: e["v"]).alias(name))


def elementwise_sum(df: DataFrame, by, vec: str, name: str) -> DataFrame:
    """Element-wise sum vector per group, as ``elementwise_mean``: partial sums per (group, position) before the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    g = df.select(*by, F.posexplode(vec).alias("__pos", "__v")).groupBy(*by, "__pos").agg(F.sum("__v").alias("__s"))
    g = g.select(*by, F.struct(F.col("__pos"), F.col("__s").alias("v")).alias("__e"))
    return g.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("__e")), lambda e: e["v"]).alias(name))
