"""Bipartite query-model graph as tables: H1-H5, P6, P10.

The reference builds dense tensors for a GNN; the data work around it is
relational: an edge list, degree counts, masks, and per-model aggregation of
visible edges.  The training loop itself is out of scope (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.functions.numeric import nan_null_to_zero, sigmoid
from routelake.operators.common import broadcast_if_small, join_dim
from routelake.operators.vectors import elementwise_mean, elementwise_sum
from routelake.session import cut_lineage

HOT_ROWS = 100_000  # edges that one copy of a node's vector serves


def edge_list(log: DataFrame, reward: str = "reward", qid: str = "query_id", llm_idx: str = "llm_idx",
              keep=()) -> DataFrame:
    """H1: edges (source = query node, target = model node) with features
    (reward, cost, performance); NULL/NaN features become 0 (P6).

    Query nodes keep their ``query_id``; model nodes are ``llm_idx`` offset
    past the largest query id, so the two node sets never overlap (the
    reference offsets by the number of queries).  The offset is one scalar
    aggregate, so no dense renumbering window over all queries is needed."""
    top = log.agg(F.max(qid).alias("m")).first()["m"]
    offset = 0 if top is None else int(top) + 1
    return log.select(
        qid, F.col(llm_idx), *keep, F.col(qid).cast("bigint").alias("src"),
        (F.col(llm_idx) + F.lit(offset)).cast("bigint").alias("dst"),
        nan_null_to_zero(reward).alias("reward"), nan_null_to_zero("cost").alias("cost"),
        nan_null_to_zero("performance").alias("performance"))


def degree_norm(edges: DataFrame) -> DataFrame:
    """H2: symmetric normalisation ``deg(src)^-1/2 * deg(dst)^-1/2``, each end's degree
    counted on its own side."""
    def inverse(side: str) -> DataFrame:
        return edges.groupBy(side).agg(F.pow(F.count(F.lit(1)).cast("double"), -0.5).alias(f"inv_{side}"))

    # src is a query: as many as the input has, and their degrees compress so well that Spark would take them for a table to broadcast.
    # dst is a model: few and hot, so its degrees are broadcast once proven small
    e = edges.join(inverse("src").hint("merge"), "src").join(broadcast_if_small(inverse("dst")), "dst")
    return e.withColumn("norm", F.col("inv_src") * F.col("inv_dst")).drop("inv_src", "inv_dst")


def message_rounds(edges: DataFrame, nodes: DataFrame, rounds: int = 2, keep: float = 0.5, src: str = "src", dst: str = "dst",
                   node: str = "node", vec: str = "vec", hot_rows: int = HOT_ROWS) -> DataFrame:
    """H4: rounds of neighbour aggregation over the (visible) ``edges``, in both directions, weighted by H2's symmetric
    degree normalisation: ``x'[v] = keep * x[v] + (1 - keep) * sum over neighbours u of norm(u, v) * x[u]``.  Returns
    ``nodes(node, vec)`` after the last round, each round being written once (reliable checkpoint).

    A model node is the neighbour of a large share of all queries.  As a sender its vector is copied once per
    ``hot_rows`` of its edges, which are dealt over the copies, so no join key holds more; as a receiver its sum is
    a partial aggregate per position.  Nodes without edges keep ``keep`` of their vector; edges of unknown nodes send and
    reach nothing; a NULL vector counts as unknown; repeated edges count once each."""
    norm = degree_norm(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")))
    both = norm.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), "norm"),
                                         F.struct(F.col("dst").alias("u"), F.col("src").alias("v"), "norm"))).alias("e")).select("e.*")
    sends = both.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / F.lit(hot_rows)).cast("int").alias("copies"))
    x = nodes.select(F.col(node).alias("node"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    hot = cut_lineage(sends.where("copies > 1"))  # few: at most edges / hot_rows
    dealt = (both.join(broadcast_if_small(hot), "u", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
             .withColumn("copy", F.pmod(F.xxhash64("v"), F.col("copies")).cast("int")).select("u", "v", "norm", "copy"))
    dealt, x = cut_lineage(dealt), cut_lineage(x)
    for _ in range(rounds):
        copied = (x.join(broadcast_if_small(hot.withColumnRenamed("u", "node")), "node", "left")
                  .withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).select(F.col("node").alias("u"), "copy", "vec"))
        sent = dealt.join(copied, ["u", "copy"]).select(F.col("v").alias("node"), F.transform("vec", lambda a: a * F.col("norm")).alias("vec"))
        got = elementwise_sum(sent, "node", "vec", "got")
        mine, heard = F.transform("vec", lambda a: a * F.lit(keep)), F.transform("got", lambda a: a * F.lit(1.0 - keep))
        x = cut_lineage(x.join(got, "node", "left").select("node", F.when(F.col("got").isNull(), mine)
                                                           .otherwise(F.zip_with(mine, heard, lambda a, b: a + b)).alias("vec")))
    return x


def edge_masks(edges: DataFrame, split_col: str, rate: float, draw) -> DataFrame:
    """H3: train / validate / test flags from a split label (M7), and the
    visible training edges after hiding a share ``rate`` of them (M9);
    ``draw`` is a reproducible [0, 1) column."""
    return (edges.withColumn("is_train", F.col(split_col) == "train")
                 .withColumn("is_validate", F.col(split_col) == "validate")
                 .withColumn("is_test", F.col(split_col) == "test")
                 .withColumn("hidden", F.col("is_train") & (draw < F.lit(rate)))
                 .withColumn("visible", F.col("is_train") & ~F.col("hidden")))


def model_profiles(edges: DataFrame, query_vectors: DataFrame, qid: str = "query_id", llm: str = "llm",
                   vec: str = "embedding", digits: int | None = 9) -> DataFrame:
    """H4: per model, mean edge features over visible edges and the
    element-wise mean vector of the queries it serves well (reward > 0)."""
    vis = edges.where(F.col("visible"))
    feats = vis.groupBy(llm).agg(F.avg("reward").alias("mean_reward"), F.avg("cost").alias("mean_cost"),
                                 F.avg("performance").alias("mean_performance"),
                                 F.count(F.lit(1)).alias("n_visible"))
    pos = vis.where(F.col("reward") > 0).join(query_vectors.select(qid, vec), qid)
    vecs = elementwise_mean(pos, llm, vec, "model_vec", digits)
    return feats.join(vecs, llm, "left")


def edge_scores(edges: DataFrame, query_vectors: DataFrame, profiles: DataFrame, qid: str = "query_id",
                llm: str = "llm", vec: str = "embedding") -> DataFrame:
    """H5: edge score = sigmoid(mean of element-wise product of the query
    vector and the model vector); the argmax per query is the routed model."""
    prof = profiles.select(llm, "model_vec")
    e = join_dim(edges, prof, llm, "left").join(query_vectors.select(qid, F.col(vec).alias("__q")), qid)
    prod = F.zip_with(F.col("__q").cast("array<double>"), F.col("model_vec"), lambda a, b: a * b)
    mean = F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v) / F.size(prod)
    return e.withColumn("edge_score", F.when(F.col("model_vec").isNotNull(), sigmoid(mean))).drop("__q")


def range_check(df: DataFrame, cols) -> DataFrame:
    """P10: per column: NaN present, values outside [0, 1], min and max (one
    aggregation pass, then ``stack`` to rows)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count_if(F.isnan(x)).alias(f"{c}__nan"),
                 F.count_if((x < 0) | (x > 1)).alias(f"{c}__out"),
                 F.min(F.when(~F.isnan(x), x)).alias(f"{c}__min"),
                 F.max(F.when(~F.isnan(x), x)).alias(f"{c}__max")]
    a = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__nan`, `{c}__out`, `{c}__min`, `{c}__max`" for c in cols)
    return a.selectExpr(f"stack({len(cols)}, {stack}) as (name, nan_count, out_of_range, min_value, max_value)") \
            .withColumn("valid", (F.col("nan_count") == 0) & (F.col("out_of_range") == 0))
