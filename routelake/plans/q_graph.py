"""Registered queries: query-model graph (H1-H5), P6, P10."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelake.operators import graph as G
from routelake.operators import ranking as R
from routelake.operators import routers as RT
from routelake.operators.common import r6
from routelake.plans import fixtures as fx
from routelake.plans.fixtures_sql import R6, with_
from routelake.plans.registry import register


def _grid_edges(spark, sf_dir):
    g = fx.f_grid(spark, sf_dir).withColumn("node_idx", F.col("llm_idx") * 2 + F.col("is_think").cast("int"))
    g = g.withColumn("reward", F.col("performance") - F.col("cost") / F.lit(100.0))
    return g


_GRID_EDGES_SQL = {"e": """
SELECT query_id, llm, task_name, llm_idx * 2 + CAST(is_think AS INTEGER) AS node_idx, performance - cost / 100.0::DOUBLE AS reward,
       cost, performance FROM fgrid""", "mx": "SELECT max(query_id) + 1 AS off FROM fgrid"}


@register("h1_edge_list", with_("fgrid", extra=_GRID_EDGES_SQL) + f"""
SELECT query_id, llm, query_id AS src, node_idx + off AS dst, {R6('reward')} AS reward, {R6('cost')} AS cost,
       {R6('performance')} AS performance FROM e, mx""")
def h1_edge_list(spark, sf_dir):
    e = G.edge_list(_grid_edges(spark, sf_dir), "reward", llm_idx="node_idx", keep=["llm"])
    return e.select("query_id", "llm", "src", "dst", r6("reward").alias("reward"), r6("cost").alias("cost"),
                      r6("performance").alias("performance"))


@register("h2_degree_norm", with_("fgrid", extra=_GRID_EDGES_SQL) + f"""
SELECT q.src, q.dst, {R6('coalesce(pow(ds.deg::DOUBLE, -0.5), 0.0) * coalesce(pow(dd.deg::DOUBLE, -0.5), 0.0)')} AS norm
FROM (SELECT query_id AS src, node_idx + off AS dst FROM e, mx) q
LEFT JOIN (SELECT query_id AS node, count(*) AS deg FROM e GROUP BY query_id) ds ON q.src = ds.node
LEFT JOIN (SELECT node_idx + off AS node, count(*) AS deg FROM e, mx GROUP BY node_idx + off) dd ON q.dst = dd.node""")
def h2_degree_norm(spark, sf_dir):
    e = G.edge_list(_grid_edges(spark, sf_dir).drop("llm_idx"), "reward", llm_idx="node_idx")
    return G.degree_norm(e).select("src", "dst", r6("norm").alias("norm"))


@register("h2_degree_norm_log", with_("flog") + f"""
SELECT query_id AS src, llm_idx, {R6('1.0 / sqrt(count(*) OVER (PARTITION BY query_id)::DOUBLE) / sqrt(count(*) OVER (PARTITION BY llm_idx)::DOUBLE)')} AS norm FROM flog""")
def h2_degree_norm_log(spark, sf_dir):
    """H2 on a log with gaps: queries and models of different degrees."""
    e = G.edge_list(fx.f_log(spark, sf_dir), "performance", keep=["llm"])
    return G.degree_norm(e).select("src", "llm_idx", r6("norm").alias("norm"))


_MASK_DRAW = "((query_id * 31 + node_idx * 17 + 3) % 1000) / 1000.0"


@register("h3_edge_masks", with_("fgrid", extra={**_GRID_EDGES_SQL, "k": """
SELECT task_name, query_id,
  CASE WHEN r < floor(q * 0.7::DOUBLE) THEN 'train' WHEN r < floor(q * 0.7::DOUBLE) + floor(q * 0.1::DOUBLE) THEN 'validate'
       WHEN r < floor(q * 0.7::DOUBLE) + floor(q * 0.1::DOUBLE) + floor(q * 0.2::DOUBLE) THEN 'test' ELSE 'none' END AS split_role
FROM (SELECT task_name, query_id, row_number() OVER (PARTITION BY task_name ORDER BY query_id) - 1 AS r,
             count(*) OVER (PARTITION BY task_name) AS q FROM (SELECT DISTINCT task_name, query_id FROM e) d) t""", "m": f"""
SELECT e.*, k.split_role, k.split_role = 'train' AS is_train, k.split_role = 'validate' AS is_validate, k.split_role = 'test' AS is_test,
       k.split_role = 'train' AND {_MASK_DRAW.replace('query_id', 'e.query_id')} < 0.5 AS hidden FROM e JOIN k ON e.task_name = k.task_name AND e.query_id = k.query_id"""}) + """
SELECT is_train, is_validate, is_test, hidden, is_train AND NOT hidden AS visible, count(*) AS n_edges FROM m GROUP BY ALL""")
def h3_edge_masks(spark, sf_dir):
    g = _grid_edges(spark, sf_dir)
    s = R.ratio_split(g, "task_name", "query_id", (0.7, 0.1, 0.2))
    draw = ((F.col("query_id") * 31 + F.col("node_idx") * 17 + 3) % 1000) / F.lit(1000.0)
    m = G.edge_masks(s, "split_role", 0.5, draw)
    return m.groupBy("is_train", "is_validate", "is_test", "hidden", "visible").agg(F.count(F.lit(1)).alias("n_edges"))


def _vec_edges(spark, sf_dir):
    """Edges between every F-VEC query and ten models; reward 1 for the label model."""
    v = fx.f_vec(spark, sf_dir)
    e = v.select(F.col("vec_id").alias("query_id"), "label", "split", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("llm_idx"))
    e = e.select("query_id", "llm_idx", "split", F.concat(F.lit("model_"), F.col("llm_idx").cast("string")).alias("llm"),
                 (F.col("llm_idx") == F.col("label")).cast("double").alias("reward"),
                 (F.col("llm_idx") / F.lit(10.0)).alias("cost"),
                 (F.col("llm_idx") == F.col("label")).cast("double").alias("performance"))
    draw = ((F.col("query_id") * 13 + F.col("llm_idx") * 7 + 1) % 100) / F.lit(100.0)
    return G.edge_masks(e, "split", 0.3, draw)


_VEC_EDGES_SQL = {
    "e": """SELECT vec_id AS query_id, i AS llm_idx, split, 'model_' || CAST(i AS VARCHAR) AS llm,
              CASE WHEN i = label THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, i / 10.0::DOUBLE AS cost,
              split = 'train' AND ((vec_id * 13 + i * 7 + 1) % 100) / 100.0 >= 0.3 AS visible, embedding
            FROM fvec, range(0, 10) r(i)""",
    "pv": """SELECT llm, list(round(m * 1000000000.0) / 1000000000.0 ORDER BY pos) AS model_vec FROM (
               SELECT llm, pos, avg(x) AS m FROM (SELECT llm, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos
                                                 FROM e WHERE visible AND reward > 0) a GROUP BY llm, pos) b GROUP BY llm""",
}


@register("h4_model_profiles", with_("fvec", extra=_VEC_EDGES_SQL) + f"""
SELECT f.llm, {R6('f.mean_reward')} AS mean_reward, {R6('f.mean_cost')} AS mean_cost, f.n_visible,
       {R6('list_sum(pv.model_vec)')} AS vec_sum
FROM (SELECT llm, avg(reward) AS mean_reward, avg(cost) AS mean_cost, count(*) AS n_visible FROM e WHERE visible GROUP BY llm) f
LEFT JOIN pv ON f.llm = pv.llm""")
def h4_model_profiles(spark, sf_dir):
    e = _vec_edges(spark, sf_dir)
    qv = fx.f_vec(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    p = G.model_profiles(e, qv)
    return p.select("llm", r6("mean_reward").alias("mean_reward"), r6("mean_cost").alias("mean_cost"), "n_visible",
                    r6(F.aggregate("model_vec", F.lit(0.0), lambda a, x: a + x)).alias("vec_sum"))


def _round_nodes(spark, sf_dir):
    """Query nodes carry their vectors; the ten model nodes (ids -1 .. -10) those of the vectors 0 to 9, as their descriptions."""
    v = fx.f_vec(spark, sf_dir)
    models = v.where("vec_id < 10").select((-F.col("vec_id") - 1).alias("node"), F.col("embedding").alias("vec"))
    return v.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec")).unionByName(models)


def _two_rounds(spark, sf_dir):
    e = _vec_edges(spark, sf_dir).where("visible and (reward > 0 or query_id % 3 = llm_idx % 3)")
    e = e.select(F.col("query_id").alias("src"), (-F.col("llm_idx") - 1).alias("dst"))
    return G.message_rounds(e, _round_nodes(spark, sf_dir), rounds=2, hot_rows=50)


_ROUNDS_SQL = {
    **_VEC_EDGES_SQL,
    "ve": "SELECT query_id AS src, -llm_idx - 1 AS dst FROM e WHERE visible AND (reward > 0 OR query_id % 3 = llm_idx % 3)",
    "en": """SELECT src, dst, 1.0 / sqrt(count(*) OVER (PARTITION BY src)::DOUBLE) / sqrt(count(*) OVER (PARTITION BY dst)::DOUBLE) AS norm FROM ve""",
    "b": "SELECT src AS u, dst AS v, norm FROM en UNION ALL SELECT dst, src, norm FROM en",
    "x0": """SELECT vec_id AS node, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM fvec
             UNION ALL SELECT -vec_id - 1, unnest(embedding), unnest(range(len(embedding))) FROM fvec WHERE vec_id < 10""",
    "r": """SELECT 0 AS k, node, pos, x FROM x0 UNION ALL
            SELECT k + 1, node, pos, sum(x) FROM (
              SELECT k, node, pos, 0.5 * x AS x FROM r WHERE k < 2
              UNION ALL SELECT r.k, b.v, r.pos, 0.5 * b.norm * r.x FROM r JOIN b ON r.node = b.u WHERE r.k < 2) t GROUP BY k, node, pos""",
}


@register("h4_two_rounds", with_("fvec", extra=_ROUNDS_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT node, pos, {R6('x')} AS value FROM r WHERE k = 2""")
def h4_two_rounds(spark, sf_dir):
    """Two rounds of aggregation over the visible edges; hot models are dealt over copies (one per 50 edges)."""
    x = _two_rounds(spark, sf_dir)
    return x.select("node", F.posexplode("vec").alias("pos", "value")).select("node", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


@register("h5_two_round_routing", with_("fvec", extra={**_ROUNDS_SQL, "s": """
SELECT te.vec_id AS query_id, -m.node - 1 AS llm_idx, 1.0 / (1.0 + exp(-avg(te.x * m.x))) AS s
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM fvec WHERE split = 'test') te
JOIN r m ON m.k = 2 AND m.node < 0 AND m.pos = te.pos GROUP BY ALL"""}).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT query_id, llm AS predicted, {R6('s')} AS edge_score FROM (
  SELECT *, 'model_' || CAST(llm_idx AS VARCHAR) AS llm, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, llm_idx) AS rn FROM s) t WHERE rn = 1""")
def h5_two_round_routing(spark, sf_dir):
    """H5 with the model vectors of two rounds: a query's own vector against each model's aggregated one."""
    x = _two_rounds(spark, sf_dir).where("node < 0")
    prof = x.select(F.concat(F.lit("model_"), (-F.col("node") - 1).cast("string")).alias("llm"), F.col("vec").alias("model_vec"))
    qv = fx.f_vec(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    s = G.edge_scores(_vec_edges(spark, sf_dir).where(F.col("split") == "test"), qv, prof)
    best = s.groupBy("query_id").agg(F.max_by(F.struct("llm", "edge_score"), F.struct(F.col("edge_score"), -F.col("llm_idx"))).alias("b"))
    return best.select("query_id", F.col("b.llm").alias("predicted"), r6("b.edge_score").alias("edge_score"))


@register("h5_edge_routing", with_("fvec", extra={**_VEC_EDGES_SQL, "sc": """
SELECT e.query_id, e.llm, e.llm_idx, 1.0 / (1.0 + exp(-(list_sum(list_transform(list_zip(list_transform(e.embedding, lambda x: x::DOUBLE), pv.model_vec), lambda z: z[1] * z[2])) / len(e.embedding)))) AS s
FROM e JOIN pv ON e.llm = pv.llm WHERE e.split = 'test'"""}) + f"""
SELECT query_id, llm AS predicted, {R6('s')} AS edge_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, llm_idx) AS rn FROM sc) t WHERE rn = 1""")
def h5_edge_routing(spark, sf_dir):
    e = _vec_edges(spark, sf_dir)
    qv = fx.f_vec(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    prof = G.model_profiles(e, qv)
    s = G.edge_scores(e.where(F.col("split") == "test"), qv, prof).where(F.col("edge_score").isNotNull())
    best = s.groupBy("query_id").agg(F.max_by(F.struct("llm", "edge_score"),
                                              F.struct(F.col("edge_score"), -F.col("llm_idx"))).alias("b"))
    return best.select("query_id", F.col("b.llm").alias("predicted"), r6("b.edge_score").alias("edge_score"))


@register("p6_null_nan_to_zero", with_("flog") + """
SELECT query_id, llm, coalesce(CASE WHEN isnan(x) THEN 0.0 ELSE x END, 0.0) AS v FROM (
  SELECT query_id, llm, CASE WHEN query_id % 4 = 0 THEN NULL WHEN query_id % 4 = 1 THEN 'nan'::DOUBLE ELSE performance END AS x FROM flog) t""")
def p6_null_nan_to_zero(spark, sf_dir):
    from routelake.functions.numeric import nan_null_to_zero
    f = fx.f_log(spark, sf_dir)
    raw = (F.when(F.col("query_id") % 4 == 0, F.lit(None).cast("double"))
            .when(F.col("query_id") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("performance")))
    return f.select("query_id", "llm", nan_null_to_zero(raw).alias("v"))


@register("p10_range_check", with_("flog") + """
SELECT name, nan_count, out_of_range, min_value, max_value, nan_count = 0 AND out_of_range = 0 AS valid FROM (
  SELECT 'performance' AS name, count(*) FILTER (WHERE isnan(performance)) AS nan_count,
         count(*) FILTER (WHERE performance < 0 OR performance > 1) AS out_of_range, min(performance) AS min_value, max(performance) AS max_value FROM flog
  UNION ALL SELECT 'llm_judge', count(*) FILTER (WHERE isnan(llm_judge)), count(*) FILTER (WHERE llm_judge < 0 OR llm_judge > 1),
         min(llm_judge), max(llm_judge) FROM flog
  UNION ALL SELECT 'cost', count(*) FILTER (WHERE isnan(cost)), count(*) FILTER (WHERE cost < 0 OR cost > 1), min(cost), max(cost) FROM flog) t""")
def p10_range_check(spark, sf_dir):
    return G.range_check(fx.f_log(spark, sf_dir), ["performance", "llm_judge", "cost"])


@register("g13_graph_router_eval", with_("fvec", extra={**_VEC_EDGES_SQL, "sc": """
SELECT e.query_id, e.llm_idx, e.reward, e.cost, e.reward AS performance, coalesce(1.0 / (1.0 + exp(-(list_sum(list_transform(list_zip(e.embedding, pv.model_vec), lambda z: z[1] * z[2]))
         / len(e.embedding)))), 0.0) AS s FROM e LEFT JOIN pv ON e.llm = pv.llm WHERE e.split = 'test'""", "rk": """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, llm_idx) AS rp, row_number() OVER (PARTITION BY query_id ORDER BY reward DESC, llm_idx) AS rg FROM sc"""}) + f"""
SELECT {R6('avg(reward) FILTER (WHERE rp = 1)')} AS result_predict, {R6('avg(reward) FILTER (WHERE rg = 1)')} AS result_golden,
       {R6('avg(cost) FILTER (WHERE rp = 1)')} AS predict_cost, {R6('avg(performance) FILTER (WHERE rp = 1)')} AS predict_performance FROM rk""")
def g13_graph_router_eval(spark, sf_dir):
    """G13 on the H5 edge scores."""
    e = _vec_edges(spark, sf_dir)
    qv = fx.f_vec(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    s = G.edge_scores(e.where(F.col("split") == "test"), qv, G.model_profiles(e, qv))
    m = RT.predicted_vs_golden(s.fillna(0.0, ["edge_score"]), "edge_score", "reward", pos="llm_idx")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@register("g13_sub_range", with_("fvec", extra={**_VEC_EDGES_SQL, "rk": """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -cost DESC, llm_idx) AS rp, row_number() OVER (PARTITION BY query_id ORDER BY reward DESC, llm_idx) AS rg
FROM e WHERE split = 'test' AND llm_idx >= 3 AND llm_idx < 8"""}) + f"""
SELECT {R6('avg(reward) FILTER (WHERE rp = 1)')} AS result_predict, {R6('avg(reward) FILTER (WHERE rg = 1)')} AS result_golden,
       {R6('avg(cost) FILTER (WHERE rp = 1)')} AS predict_cost, {R6('avg(reward) FILTER (WHERE rp = 1)')} AS predict_performance FROM rk""")
def g13_sub_range(spark, sf_dir):
    """G13 over the candidates 3 to 7 only: the cheapest of them against the best of them."""
    e = _vec_edges(spark, sf_dir).where(F.col("split") == "test").withColumn("pred", -F.col("cost"))
    m = RT.predicted_vs_golden(e, "pred", "reward", pos="llm_idx", lo=3, hi=8)
    return m.select(*[r6(c).alias(c) for c in m.columns])
