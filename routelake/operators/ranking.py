"""Sampling, slicing and per-group ranking: M1-M9, W2 W4-W15, G5, U1 U3 U4.

Windows here are partitioned by a query (bounded by the model catalogue) or
applied after a pre-aggregation to one row per key, so no window ever sorts a
whole task in one slot.  ``row_number() <= k`` filters compile to
``WindowGroupLimit``, which trims each input partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelake.operators.common import seeded_key, unit_interval


def _cols(x):
    return [x] if isinstance(x, (str, Column)) else list(x)


# ---------------------------------------------------------------- numbering
def number_within_groups(df: DataFrame, by, order, name: str = "rn", partitions: int | None = None) -> DataFrame:
    """1-based row number within each group, skew-safe.

    ``repartitionByRange(by, order)`` splits even a hot group over many
    partitions (equal keys stay together).  Each (partition, group) slice is
    numbered locally; its offset is the running sum of the slice counts of
    the same group in earlier partitions (one row per slice, so that window
    holds at most #partitions rows per group).  ``order`` must make rows
    unique within a group for a deterministic numbering.
    """
    from routelake.session import cut_lineage
    by, order = _cols(by), _cols(order)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The slice id is materialised once: a range exchange executed twice may
    # sample different bounds, so both uses below must read the same ids.
    r = cut_lineage(df.repartitionByRange(n, *by, *order).withColumn("__pid", F.spark_partition_id()))
    counts = r.groupBy("__pid", *by).agg(F.count(F.lit(1)).alias("__n"))
    prior = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("__off", F.coalesce(F.sum("__n").over(prior), F.lit(0))).drop("__n")
    local = Window.partitionBy("__pid", *by).orderBy(*order)
    from routelake.operators.common import broadcast_if_small
    out = (r.withColumn("__local", F.row_number().over(local))
            .join(broadcast_if_small(offs), ["__pid", *by])
            .withColumn(name, (F.col("__off") + F.col("__local")).cast("bigint")))
    return out.drop("__pid", "__local", "__off")


# ---------------------------------------------------------------- sampling
def hash_order(seed: int, id_cols):
    """Seeded order key list: hash of (seed, ids), ids as tie-break."""
    return [seeded_key(seed, *_cols(id_cols)), *_cols(id_cols)]


def top_n_per_group(df: DataFrame, by, order, n: int) -> DataFrame:
    """M1/M4/M5: first ``min(n, size)`` rows per group in ``order``.

    For a seeded random sample pass ``hash_order(seed, ids)``: the sample then
    does not depend on partitioning or input order.  ``row_number <= n``
    becomes a WindowGroupLimit (partial top-n before the shuffle), so a hot
    group is trimmed map-side.
    """
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def sample_per_group(df: DataFrame, by, n: int, seed: int, id_cols) -> DataFrame:
    """M1/M5: seeded random ``min(n, size)`` rows per group without replacement."""
    return top_n_per_group(df, by, hash_order(seed, id_cols), n)


def stratified_sample(df: DataFrame, category: str, total_n: int, n_categories: int, order) -> DataFrame:
    """M2: ``total_n // n_categories + 1`` rows per category."""
    return top_n_per_group(df, category, order, total_n // n_categories + 1)


def head_sorted(df: DataFrame, order, n: int) -> DataFrame:
    """M4: first ``n`` rows in ``order`` (TakeOrderedAndProject: per-partition top-n)."""
    return df.orderBy(*_cols(order)).limit(n)


def slice_sorted(df: DataFrame, order, start: int, end: int | None, key) -> DataFrame:
    """M3: rows at positions ``[start, end)`` of ``order``; ``end=None`` is the tail.

    ``[start, end)`` is a bounded top-n with an offset; the tail is an anti join with
    the bounded head ``[0, start)`` so it never funnels the data through a
    single window partition.
    """
    if end is not None:
        return df.orderBy(*_cols(order)).offset(start).limit(end - start)
    if start <= 0:
        return df
    from routelake.operators.common import broadcast_if_small
    top = head_sorted(df, order, start).select(*_cols(key))
    return df.join(broadcast_if_small(top), _cols(key), "left_anti")


def first_k_keys_per_group(df: DataFrame, by, key: str, k: int) -> DataFrame:
    """M6: rows whose ``key`` is among the first ``k`` distinct keys (sorted) of their group.

    Distinct (group, key) pairs are computed first (partial aggregation), then
    ranked; the selected keys are semi-joined back.
    """
    from routelake.operators.common import broadcast_if_small
    by = _cols(by)
    keys = df.select(*by, key).distinct()
    w = Window.partitionBy(*by).orderBy(key)
    top = keys.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
    # k keys per group: broadcast once proven small, so the log is not shuffled on (group, key).
    return df.join(broadcast_if_small(top), by + [key], "left_semi")


def ratio_split(df: DataFrame, by, key: str, ratios=(0.9, 0.0, 0.1),
                names=("train", "validate", "test")) -> DataFrame:
    """M7: per group, contiguous split of the sorted distinct keys.

    Sizes are ``int(q * ratio)`` each, in order; the remainder is ``none``.
    Works on one row per key (distinct first), numbers keys with the
    skew-safe ``number_within_groups``, then joins the label back.
    """
    by = _cols(by)
    from routelake.operators.common import broadcast_if_small
    numbered = number_within_groups(df.select(*by, key).distinct(), by, key, "__r")
    # Group size = largest number in the group (a partial aggregate over the
    # numbered keys; the log itself is not read again).
    sizes = numbered.groupBy(*by).agg(F.max("__r").alias("__q"))
    k = numbered.withColumn("__r", F.col("__r") - 1).join(broadcast_if_small(sizes), by)
    acc, label = F.lit(0), None
    for name, r in zip(names, ratios):
        size = F.floor(F.col("__q") * F.lit(float(r))).cast("bigint")
        lo, hi = acc, acc + size
        cond = (F.col("__r") >= lo) & (F.col("__r") < hi)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
        acc = hi
    k = k.withColumn("split_role", label.otherwise(F.lit("none"))).drop("__r", "__q")
    return df.join(k, by + [key], "left")


def seeded_shuffle(df: DataFrame, seed: int, id_cols, position: str | None = None) -> DataFrame:
    """M8: deterministic permutation (only where order matters), in the order of the
    md5 of seed and ids.  With ``position``, that column holds each row's 1-based place
    and the rows are left unsorted (numbered in range slices, not in one window)."""
    ids = _cols(id_cols)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))
    if position is None:
        return df.orderBy(key, *ids)
    return number_within_groups(df.withColumn("__all", F.lit(0)).withColumn("__key", key), "__all", ["__key", *ids], position).drop("__all", "__key")


def random_mask(df: DataFrame, rate: float, seed: int, id_cols, name: str = "hidden",
                draw: Column | None = None) -> DataFrame:
    """M9: flag each row with probability ``rate``.

    ``draw`` is a reproducible number in [0, 1) per row; by default a hash of
    (seed, ids)."""
    u = draw if draw is not None else unit_interval(seed, *_cols(id_cols))
    return df.withColumn(name, u < F.lit(rate))


# ---------------------------------------------------------------- windows
def chunk_by_position(df: DataFrame, size: int = 40, by="split", group: str = "query_id",
                      pos: str = "pos", keep_partial: bool = True) -> DataFrame:
    """W2 (fidelity mode): chunk id = (global position - 1) div ``size`` within
    ``by``, rows ordered by (``group``, ``pos``).

    The default elsewhere is to group by ``query_id`` (see D3); this mode
    reproduces positional slicing.  Positions are built from per-group row
    counts (one row per query, ~40x fewer rows than the log) with a
    range-partitioned prefix sum, joined back; no window ever holds a whole
    split.  ``keep_partial=False`` drops a short tail chunk (the SFT
    exporters do).
    """
    by = _cols(by)
    counts = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("__n"))
    # Offset of each group = rows of all earlier groups in the same ``by``:
    # number the per-group count rows skew-safely, then prefix-sum them per
    # range slice (see number_within_groups) instead of one window per ``by``.
    offs = _prefix_sum(counts, by, group, "__n", "__off")
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    w = Window.partitionBy(*by, group).orderBy(pos)
    out = (df.withColumn("__p", F.row_number().over(w))
             .join(offs.drop("__n"), by + [group])
             .withColumn("position", (F.col("__off") + F.col("__p")).cast("bigint"))
             .withColumn("chunk", F.floor((F.col("position") - 1) / F.lit(size)).cast("bigint")))
    if not keep_partial:
        from routelake.operators.common import broadcast_if_small
        out = (out.join(broadcast_if_small(total), by)
                  .where(F.col("chunk") < F.floor(F.col("__total") / F.lit(size)))
                  .drop("__total"))
    return out.drop("__off", "__p")


def _prefix_sum(df: DataFrame, by, order: str, value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` within ``by`` in ``order``, skew-safe:
    range slices are summed locally and offset by the totals of earlier slices."""
    from routelake.session import cut_lineage
    by = _cols(by)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cut_lineage(df.repartitionByRange(n, *by, order).withColumn("__pid", F.spark_partition_id()))
    tot = r.groupBy("__pid", *by).agg(F.sum(value).alias("__t"))
    prior = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.withColumn("__base", F.coalesce(F.sum("__t").over(prior), F.lit(0))).drop("__t")
    local = Window.partitionBy("__pid", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    from routelake.operators.common import broadcast_if_small
    out = (r.withColumn("__in", F.coalesce(F.sum(value).over(local), F.lit(0)))
            .join(broadcast_if_small(offs), ["__pid", *by])
            .withColumn(name, F.col("__base") + F.col("__in")))
    return out.drop("__pid", "__in", "__base")


def first_per_group(df: DataFrame, by, order) -> DataFrame:
    """The first row of each group in ``order``."""
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def two_stage_top(df: DataFrame, by, n: int, first_n: int = 5, pos: str = "pos") -> DataFrame:
    """Top ``first_n`` by (performance desc, cost asc), then top ``n`` of those
    by (llm_judge desc, cost asc); ties keep input order (``pos``)."""
    by = _cols(by)
    w1 = Window.partitionBy(*by).orderBy(F.col("performance").desc_nulls_last(),
                                         F.col("cost").asc_nulls_last(), F.col(pos))
    s1 = df.withColumn("stage1_rank", F.row_number().over(w1)).where(F.col("stage1_rank") <= first_n)
    w2 = Window.partitionBy(*by).orderBy(F.col("llm_judge").desc_nulls_last(),
                                         F.col("cost").asc_nulls_last(), F.col("stage1_rank"))
    return s1.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)


# Sort keys per SFT setting (both descending, nulls last).
SFT_SORT_KEYS = {
    "perf": ("performance_processed", "output_tokens_num_processed"),
    "judge": ("llm_judge_processed", "output_tokens_num_processed"),
    "hybrid": ("performance_processed", "llm_judge_processed"),
    "baseline": ("performance_processed", "output_tokens_num_processed"),
}


def setting_order(setting: str, pos: str = "pos"):
    """The per-group order for an SFT setting, stable on ``pos``."""
    if setting not in SFT_SORT_KEYS:
        raise NotImplementedError(setting)
    a, b = SFT_SORT_KEYS[setting]
    return [F.col(a).desc_nulls_last(), F.col(b).desc_nulls_last(), F.col(pos)]


def rank_within(df: DataFrame, by, order, name: str = "rank") -> DataFrame:
    """1-based ``row_number`` per group."""
    w = Window.partitionBy(*_cols(by)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def rank_settings(df: DataFrame, by, settings, pos: str = "pos") -> DataFrame:
    """W6 for several settings: a row per row and setting with its ``rank``.  All ranks come from one shuffle of the rows (their windows
    share the partitioning), then each row is unfolded."""
    w = Window.partitionBy(*_cols(by))
    ranks = F.array(*[F.struct(F.lit(s).alias("setting"), F.row_number().over(w.orderBy(*setting_order(s, pos))).alias("rank")) for s in settings])
    out = df.withColumn("__ranks", ranks)
    return out.withColumn("__r", F.explode("__ranks")).select(*df.columns, "__r.setting", "__r.rank")


def take_while_top_k(df: DataFrame, by, order, k: int, stop_col: str = "performance_processed") -> DataFrame:
    """In ``order``, keep rows before the first ``stop_col = 0`` (NULL does
    not stop) and at most ``k`` of them.  Adds ``rank``."""
    w = Window.partitionBy(*_cols(by)).orderBy(*order)
    run = Window.partitionBy(*_cols(by)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.when(F.col(stop_col) == 0, 1).otherwise(0)
    out = (df.withColumn("rank", F.row_number().over(w))
             .withColumn("__stopped", F.sum(zero).over(run)))
    return out.where((F.col("__stopped") == 0) & (F.col("rank") <= k)).drop("__stopped")


def one_hot_argmax(df: DataFrame, by, score: str, pos: str = "pos", name: str = "label") -> DataFrame:
    """1 for the first maximal score in each group, else 0."""
    w = Window.partitionBy(*_cols(by)).orderBy(F.col(score).desc_nulls_last(), F.col(pos))
    return df.withColumn(name, (F.row_number().over(w) == 1).cast("int"))


def attempt_ids(df: DataFrame, by, order) -> DataFrame:
    """Running attempt id (0-based) per key."""
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order))
    return df.withColumn("completion_id", (F.row_number().over(w) - 1).cast("bigint"))


def resume_point(df: DataFrame, idx: str, value: str) -> DataFrame:
    """First index whose value is still NULL (one-row result, NULL when complete)."""
    return df.agg(F.min(F.when(F.col(value).isNull(), F.col(idx))).alias("resume_idx"))


def sink_order(df: DataFrame, keys) -> DataFrame:
    """Deterministic order at the sink, without a global sort:
    range-partition by the keys then sort within partitions."""
    return df.repartitionByRange(*_cols(keys)).sortWithinPartitions(*_cols(keys))


# ---------------------------------------------------------------- ranking metrics
def ranking_metrics(df: DataFrame, by, score: str, rel: str, k: int, pos: str = "pos") -> DataFrame:
    """W9-W11 per group: NDCG@k, Hit@k and MRR of the order by ``score`` desc.

    ``rel`` is the relevance (binary or graded).  Ideal DCG uses the same
    rows sorted by relevance.  Two windows, both partitioned by the group.
    """
    by = _cols(by)
    wr = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(pos))
    wi = Window.partitionBy(*by).orderBy(F.col(rel).desc_nulls_last(), F.col(pos))
    x = (df.withColumn("__r", F.row_number().over(wr))
           .withColumn("__i", F.row_number().over(wi)))
    disc = lambda r: F.lit(1.0) / F.log2(r.cast("double") + F.lit(1.0))
    relc = F.col(rel).cast("double")
    g = x.groupBy(*by).agg(
        F.sum(F.when(F.col("__r") <= k, relc * disc(F.col("__r")))).alias("__dcg"),
        F.sum(F.when(F.col("__i") <= k, relc * disc(F.col("__i")))).alias("__idcg"),
        F.max(F.when((F.col("__r") <= k) & (relc > 0), 1).otherwise(0)).alias("hit_at_k"),
        F.min(F.when(relc == 1, F.col("__r"))).alias("__first"))
    return g.select(
        *by,
        F.when(F.col("__idcg") > 0, F.col("__dcg") / F.col("__idcg")).otherwise(F.lit(0.0)).alias("ndcg_at_k"),
        F.col("hit_at_k").cast("double").alias("hit_at_k"),
        F.coalesce(F.lit(1.0) / F.col("__first"), F.lit(0.0)).alias("mrr"))


# ---------------------------------------------------------------- pass@k
def pass_at_k_per_problem(n, c, k: int) -> Column:
    """G5 estimator ``1 - prod(1 - k/i, i = n-c+1..n)``; 1.0 when ``n - c < k``.

    ``sequence(a, b)`` counts down when ``a > b`` in Spark, so the product is
    only formed when ``n - c >= k`` (which implies ``n - c + 1 <= n`` for k >= 1).
    """
    n = n if isinstance(n, Column) else F.col(n)
    c = c if isinstance(c, Column) else F.col(c)
    seq = F.sequence((n - c + 1).cast("bigint"), n.cast("bigint"))
    prod = F.aggregate(seq, F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i.cast("double")))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - prod)


def pass_at_k(results: DataFrame, task: str = "task_id", passed: str = "passed", ks=(1, 10, 100)) -> DataFrame:
    """Mean pass@k over problems, for each k <= min attempts (one row per k)."""
    per = results.groupBy(task).agg(F.count(F.lit(1)).alias("n"),
                                    F.count_if(F.col(passed)).alias("c"))
    rows = [F.struct(F.lit(k).alias("k"), pass_at_k_per_problem("n", "c", k).alias("p")) for k in ks]
    x = per.select("n", F.explode(F.array(*rows)).alias("s"))
    g = x.groupBy(F.col("s.k").alias("k")).agg(F.avg("s.p").alias("pass_at_k"), F.min("n").alias("__min_n"))
    return g.where(F.col("__min_n") >= F.col("k")).select(
        F.concat(F.lit("pass@"), F.col("k").cast("string")).alias("metric"), "pass_at_k")


def completeness(problems: DataFrame, results: DataFrame, key: str = "task_id") -> DataFrame:
    """Number of problems with no attempt (0 when complete)."""
    missing = problems.select(key).join(results.select(key), key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("missing_problems"))


# ---------------------------------------------------------------- set ops
def union_all(*dfs: DataFrame) -> DataFrame:
    """By-name union, missing columns become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_values(df: DataFrame, cols) -> DataFrame:
    """U4."""
    return df.select(*_cols(cols)).distinct()


def distinct_sorted_list(df: DataFrame, col: str, name: str = "models", max_values: int = 100_000) -> DataFrame:
    """Sorted distinct values (e.g. the routable models) as one array.

    The values are made distinct first and their number is proven to be at
    most ``max_values`` before they are gathered into one row; a larger set
    raises instead of funnelling into one task."""
    from routelake.operators.common import row_count_at_most
    values = df.select(col).distinct()
    if not row_count_at_most(values, max_values):
        raise ValueError(f"more than {max_values} distinct values of {col}; keep them as rows instead")
    return values.agg(F.array_sort(F.collect_list(col)).alias(name))


