"""Shared plan helpers: size-checked broadcast, stable ordering keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bound (rows) for a dimension we are willing to broadcast.  Dimensions
# here are catalogues of models, tasks, categories, templates: tens to
# thousands of rows.  Anything larger falls back to a shuffle join.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20  # of the rows as JSON text


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Runs a bounded job (``limit(max_rows + 1)``), so it never scans more than
    needed to prove the bound.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def broadcastable(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows of together at most ``max_bytes`` (one bounded job)."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def join_dim(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
             max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join a fact table to a dimension; broadcast the dimension only when its
    size is proven below ``max_rows``, else let Spark shuffle (AQE may still
    convert at runtime)."""
    if broadcastable(dim, max_rows):
        dim = F.broadcast(dim)
    return fact.join(dim, on, how)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """A derived table (e.g. per-task statistics) to be joined back to its source.

    The table is cached (recomputable from lineage if an executor is lost),
    its size proven with a bounded count, and only then broadcast.  Without
    this, the join is planned as a sort-merge join and the large side is
    shuffled on the (possibly hot) key before AQE can switch to a broadcast."""
    c = df.cache()
    if broadcastable(c, max_rows):
        return F.broadcast(c)
    return c


def planned_tasks(df: DataFrame) -> int:
    """Tasks of the last stage of ``df``'s plan, without running any of its shuffles: an exchange's own number of partitions, a scan's
    splits, a join's widest side that is not broadcast, the sum over a union. Nodes are told apart by their class."""
    def tasks(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return tasks(node.initialPlan())
        if kind == "BroadcastExchangeExec":
            return 0
        children = node.children()
        below = [children.apply(i) for i in range(children.size())]
        if kind == "ShuffleExchangeExec" or kind == "CoalesceExec":
            return node.outputPartitioning().numPartitions()
        if not below:
            return node.execute().getNumPartitions()  # a scan: its splits
        counts = [tasks(n) for n in below]
        return sum(counts) if kind == "UnionExec" else max(counts)

    return tasks(df._jdf.queryExecution().executedPlan())


def spread_if_narrow(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a narrow input (fewer planned tasks than the configured parallelism, e.g. one large row group) round-robin, so
    the row-local work after it runs in parallel. An input of as many tasks or more, from scans or from shuffles, is
    left as it is: no extra shuffle, and never fewer tasks than it had."""
    n = min_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if planned_tasks(df) >= n else df.repartition(n)


def small_rows(df: DataFrame, max_rows: int):
    """Collect a configuration-sized dimension (e.g. the model catalogue).

    Raises instead of silently truncating when the bound does not hold.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"dimension larger than {max_rows} rows; refusing to inline it")
    return rows


def seeded_key(seed: int, *cols) -> Column:
    """Deterministic pseudo-random order key (independent of partitioning)."""
    return F.xxhash64(F.lit(seed), *cols)


def unit_interval(seed: int, *cols) -> Column:
    """Deterministic pseudo-uniform number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_000)).cast("double") / F.lit(1_000_000.0)


def memo_column(fn):
    """Memoise a Column builder when it is called with plain values (column
    names, literals).  Large expressions (math canonicalisation, metric
    dispatch) cost many py4j calls to build; the built Column is immutable
    and can be reused by any DataFrame of the same JVM."""
    import functools

    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        plain = (str, int, float, bool, type(None))
        if all(isinstance(a, plain) for a in args) and all(isinstance(v, plain) for v in kwargs.values()):
            key = (args, tuple(sorted(kwargs.items())))
            if key not in cache:
                cache[key] = fn(*args, **kwargs)
            return cache[key]
        return fn(*args, **kwargs)

    return wrapper


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` as a lambda variable.

    Column trees are trees, not DAGs: a value referenced several times (or a
    struct whose fields are selected separately) is recomputed per
    reference.  Binding it as the only element of a one-item array keeps the
    expression linear and computes it once per row."""
    return F.try_element_at(F.transform(F.array(expr), fn), F.lit(1))


def r6(c) -> Column:
    """Round doubles to 6 places as ``round(x * 1e6) / 1e6``.

    ``round(x, 6)`` rounds the shortest decimal text of ``x`` in Spark but the
    binary value in DuckDB, so they disagree on near-ties; rounding the scaled
    value to an integer agrees in both (half away from zero)."""
    x = c if isinstance(c, Column) else F.col(c)
    return F.round(x * F.lit(1e6)) / F.lit(1e6)
