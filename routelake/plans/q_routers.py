"""Registered queries: routers (R1-R6) and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelake.operators import labels as L
from routelake.operators import routers as RT
from routelake.operators.common import r6, small_rows
from routelake.operators.knn_join import knn_join
from routelake.operators.vectors import knn_topk
from routelake.plans import fixtures as fx
from routelake.plans.fixtures_sql import R6, with_
from routelake.plans.registry import register


def vec_train(spark, sf_dir):
    v = fx.f_vec(spark, sf_dir).where(F.col("split") == "train")
    return v.select(F.col("vec_id").alias("query_id"), "embedding", F.col("model").alias("ground_truth"))


def vec_test(spark, sf_dir):
    v = fx.f_vec(spark, sf_dir).where(F.col("split") == "test")
    return v.select(F.col("vec_id").alias("query_id"), "embedding", "label", F.col("model").alias("true_model"))


def vec_candidates(test, restrict: bool = False):
    """Ten candidate models per test query (a literal sequence, no join).
    ``restrict`` keeps only models with ``(i + query_id) % 3 != 0``."""
    c = test.select("query_id", "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    if restrict:
        c = c.where((F.col("i") + F.col("query_id")) % 3 != 0)
    perf = (F.col("i") == F.col("label")).cast("double")
    return c.select("query_id", F.concat(F.lit("model_"), F.col("i").cast("string")).alias("candidate_name"),
                    perf.alias("performance"), (F.col("i") / F.lit(10.0)).alias("cost"),
                    (perf - F.lit(0.5) * F.col("i") / F.lit(10.0)).alias("score"))


_VEC = {
    "te": "SELECT vec_id AS qid, embedding, label, model AS true_model FROM fvec WHERE split = 'test'",
    "tr": "SELECT vec_id AS nid, embedding, model FROM fvec WHERE split = 'train'",
    "s": """SELECT te.qid, tr.nid, tr.model,
              CASE WHEN sqrt(list_dot_product(te.embedding, te.embedding)) * sqrt(list_dot_product(tr.embedding, tr.embedding)) = 0 THEN 0.0
                   ELSE list_dot_product(te.embedding, tr.embedding)
                        / (sqrt(list_dot_product(te.embedding, te.embedding)) * sqrt(list_dot_product(tr.embedding, tr.embedding))) END AS sim
            FROM te, tr""",
    "nb": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, nid) AS rn FROM s) t WHERE rn <= 50",
    "v": """SELECT qid, model, count(*)::DOUBLE / max(n) AS score FROM (
              SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM nb) t GROUP BY qid, model""",
    "cand": """SELECT qid, 'model_' || CAST(i AS VARCHAR) AS model, CASE WHEN i = label THEN 1.0 ELSE 0.0 END::DOUBLE AS performance,
                 i / 10.0::DOUBLE AS cost, (CASE WHEN i = label THEN 1.0 ELSE 0.0 END::DOUBLE - 0.5::DOUBLE * i / 10.0::DOUBLE) AS score, i
               FROM te, range(0, 10) r(i)""",
    "scored": """SELECT c.qid, c.model, coalesce(v.score, 0.0) AS score FROM cand c LEFT JOIN v ON c.qid = v.qid AND c.model = v.model""",
    "pred": """SELECT qid, model AS predicted, score AS predicted_score FROM (
                 SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, model) AS rn FROM scored) t WHERE rn = 1""",
}


def _knn_pred(spark, sf_dir):
    tr, te = vec_train(spark, sf_dir), vec_test(spark, sf_dir)
    return RT.knn_router(tr, te, vec_candidates(te), k=50), te


@register("r1_knn_neighbours", with_("fvec", extra={k: _VEC[k] for k in ("te", "tr", "s", "nb")}) + f"""
SELECT qid AS query_id, nid AS neighbour_id, {R6('sim')} AS sim, CAST(rn AS INTEGER) AS rank FROM nb""")
def r1_knn_neighbours(spark, sf_dir):
    tr, te = vec_train(spark, sf_dir), vec_test(spark, sf_dir)
    nb = knn_topk(te, tr, 50, "query_id", "embedding", "query_id", "embedding")
    return nb.select(F.col("qid").alias("query_id"), F.col("iid").alias("neighbour_id"), r6("sim").alias("sim"), "rank")


@register("r1_knn_join", with_("fvec", extra={k: _VEC[k] for k in ("te", "tr", "s", "nb")}) + f"""
SELECT qid AS query_id, nid AS neighbour_id, {R6('sim')} AS sim, CAST(rn AS INTEGER) AS rank FROM nb""")
def r1_knn_join(spark, sf_dir):
    """R1 by the join that skips cells: 32 pivots, blocks of 256 items, so that cells, blocks and both passes take part at any size."""
    tr, te = vec_train(spark, sf_dir), vec_test(spark, sf_dir)
    nb = knn_join(te, tr, 50, "query_id", "embedding", "query_id", "embedding", pivots=32, block_rows=256)
    return nb.select(F.col("qid").alias("query_id"), F.col("iid").alias("neighbour_id"), r6("sim").alias("sim"), "rank")


@register("r1_knn_router", with_("fvec", extra=_VEC) + f"""
SELECT qid AS query_id, predicted, {R6('predicted_score')} AS predicted_score FROM pred""")
def r1_knn_router(spark, sf_dir):
    pred, _ = _knn_pred(spark, sf_dir)
    return pred.select("query_id", "predicted", r6("predicted_score").alias("predicted_score"))


@register("j8_predicted_outcomes", with_("fvec", extra=_VEC) + f"""
SELECT p.qid AS query_id, p.predicted, {R6('c.performance')} AS performance, {R6('c.cost')} AS cost, {R6('c.score')} AS score
FROM pred p JOIN cand c ON p.qid = c.qid AND p.predicted = c.model""")
def j8_predicted_outcomes(spark, sf_dir):
    pred, te = _knn_pred(spark, sf_dir)
    o = RT.predicted_outcomes(pred, vec_candidates(te))
    return o.select("query_id", "predicted", r6("performance").alias("performance"), r6("cost").alias("cost"),
                    r6("score").alias("score"))


@register("g3_router_report", with_("fvec", extra=_VEC) + f"""
SELECT {R6('coalesce(avg(c.performance), 0.0)')} AS avg_performance, {R6('coalesce(avg(c.cost), 0.0)')} AS avg_cost,
       {R6('coalesce(avg(c.score), 0.0)')} AS avg_score, count(*) AS n_predicted
FROM pred p JOIN cand c ON p.qid = c.qid AND p.predicted = c.model""")
def g3_router_report(spark, sf_dir):
    pred, te = _knn_pred(spark, sf_dir)
    rep = RT.router_report(RT.predicted_outcomes(pred, vec_candidates(te)))
    return rep.select(r6("avg_performance").alias("avg_performance"), r6("avg_cost").alias("avg_cost"),
                      r6("avg_score").alias("avg_score"), "n_predicted")


@register("j7_restrict_available", with_("fvec", extra=_VEC) + """
SELECT v.qid AS query_id, v.model, v.score FROM v
WHERE EXISTS (SELECT 1 FROM te, range(0, 10) r(i) WHERE te.qid = v.qid AND (i + te.qid) % 3 <> 0
              AND 'model_' || CAST(i AS VARCHAR) = v.model)""")
def j7_restrict_available(spark, sf_dir):
    tr, te = vec_train(spark, sf_dir), vec_test(spark, sf_dir)
    votes = RT.knn_scores(tr, te, 50)
    return RT.restrict_to_available(votes, vec_candidates(te, restrict=True))


@register("g12_accuracy_macro_f1", with_("fvec", extra={**_VEC, "x": """
SELECT p.qid, p.predicted, te.true_model FROM pred p JOIN te ON p.qid = te.qid""", "cls": """
SELECT cls, sum(tp) AS tp, sum(np) AS np, sum(nt) AS nt FROM (
  SELECT predicted AS cls, CASE WHEN predicted = true_model THEN 1 ELSE 0 END AS tp, 1 AS np, 0 AS nt FROM x
  UNION ALL SELECT true_model, 0, 0, 1 FROM x) t GROUP BY cls""", "f": """
SELECT CASE WHEN np = 0 THEN 0.0 ELSE tp::DOUBLE / np END AS p, CASE WHEN nt = 0 THEN 0.0 ELSE tp::DOUBLE / nt END AS r FROM cls"""}) + f"""
SELECT 'accuracy' AS metric, {R6('avg(CASE WHEN predicted = true_model THEN 1.0 ELSE 0.0 END::DOUBLE)')} AS value FROM x
UNION ALL SELECT 'macro_f1', {R6('avg(CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END::DOUBLE)')} FROM f""")
def g12_accuracy_macro_f1(spark, sf_dir):
    pred, te = _knn_pred(spark, sf_dir)
    m = RT.accuracy_macro_f1(pred, te)
    return m.select("metric", r6("value").alias("value"))


@register("r5_centroid_router", with_("fvec", extra={**{k: _VEC[k] for k in ("te", "tr", "cand")}, "ce": """
SELECT model, list(round(m * 1000000000.0) / 1000000000.0 ORDER BY pos) AS cvec FROM (
  SELECT model, pos, avg(x) AS m FROM (SELECT model, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM tr) a
  GROUP BY model, pos) b GROUP BY model""", "sc": """
SELECT c.qid, c.model, CASE WHEN sqrt(list_dot_product(te.embedding, te.embedding)) * sqrt(list_dot_product(ce.cvec, ce.cvec)) = 0 THEN 0.0
   ELSE list_dot_product(te.embedding, ce.cvec) / (sqrt(list_dot_product(te.embedding, te.embedding)) * sqrt(list_dot_product(ce.cvec, ce.cvec))) END AS score
FROM cand c JOIN ce ON c.model = ce.model JOIN te ON c.qid = te.qid"""}) + f"""
SELECT qid AS query_id, model AS predicted, {R6('score')} AS predicted_score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, model) AS rn FROM sc) t WHERE rn = 1""")
def r5_centroid_router(spark, sf_dir):
    tr, te = vec_train(spark, sf_dir), vec_test(spark, sf_dir)
    p = RT.centroid_router(tr, te, vec_candidates(te))
    return p.select("query_id", "predicted", r6("predicted_score").alias("predicted_score"))


def _models(spark, sf_dir):
    return [r["model"] for r in small_rows(RT.route_models(vec_candidates(vec_test(spark, sf_dir))).orderBy("model"), 10_000)]


#: The normal equations of all models, solved by Gauss-Jordan steps over the rows of (X'X + ridge | X'Y).
_R2 = {
    **{k: _VEC[k] for k in ("te", "tr")},
    "xs": "SELECT list_concat([1.0::DOUBLE], embedding) AS x, model FROM tr",
    "dims": "SELECT max(len(x)) AS d, count(*) AS n FROM xs",
    "names": "SELECT model, row_number() OVER (ORDER BY model) AS p FROM (SELECT DISTINCT model FROM tr) t",
    "xi": "SELECT rowid AS r, model, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM (SELECT *, row_number() OVER () AS rowid FROM xs) t",
    "cells": """SELECT a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i AND a.i > 1 THEN 0.01 * (SELECT n FROM dims) ELSE 0 END AS v
                FROM xi a JOIN xi b ON a.r = b.r GROUP BY a.i, b.i
                UNION ALL SELECT i, (SELECT d FROM dims) + p, coalesce(sum(v) FILTER (WHERE xi.model = names.model), 0.0) FROM xi, names GROUP BY i, p""",
    "mat": "SELECT list(w ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS w FROM cells GROUP BY i) t",
    "step": """SELECT 0 AS k, m FROM mat UNION ALL
               SELECT k + 1, list_transform(m, lambda w, i: CASE WHEN i = k + 1 THEN list_transform(w, lambda z: z / w[k + 1])
                 ELSE list_transform(w, lambda z, j: z - w[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
               FROM step WHERE k < (SELECT d FROM dims)""",
    "weights": """SELECT model, list_transform(m, lambda w: w[d + p]) AS w FROM (SELECT arg_max(m, k) AS m FROM step) t, names, dims""",
    "sc": """SELECT te.qid, w.model, list_dot_product(list_concat([1.0::DOUBLE], te.embedding), w.w) AS score FROM te, weights w
             WHERE w.model IN (SELECT 'model_' || CAST(i AS VARCHAR) FROM range(0, 10) t(i))""",
}


@register("r2_linear_router", with_("fvec", extra=_R2).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT qid AS query_id, model AS predicted, {R6('score')} AS predicted_score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, model) AS rn FROM sc) t WHERE rn = 1""")
def r2_linear_router(spark, sf_dir):
    tr, te = vec_train(spark, sf_dir), vec_test(spark, sf_dir)
    return RT.linear_router(tr, te, vec_candidates(te)).select("query_id", "predicted", r6("predicted_score").alias("predicted_score"))


@register("r3_mlp_router")
def r3_mlp_router(spark, sf_dir):
    tr, te = vec_train(spark, sf_dir), vec_test(spark, sf_dir)
    return RT.mlp_router(tr, te, vec_candidates(te), _models(spark, sf_dir))


@register("r6_pca_reduce")
def r6_pca_reduce(spark, sf_dir):
    """The vectors in 8 principal components (tests hold them against a dense decomposition)."""
    out = RT.pca_reduce(fx.f_vec(spark, sf_dir), "embedding", k=8)
    return out.select("vec_id", F.transform("reduced", r6).alias("reduced"))


_R6_VARIANCE = {"p": "SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM fvec"}


@register("r6_pca_report", with_("fvec", extra=_R6_VARIANCE) + f"""
SELECT (SELECT count(*) FROM fvec) AS vectors, {R6('sum(s)')} AS total_variance, {R6('sum(s)')} AS kept_variance, 0.0::DOUBLE AS mean_sq_error
FROM (SELECT i, var_samp(v) AS s FROM p GROUP BY i) t""")
def r6_pca_report(spark, sf_dir):
    """All components: they keep the whole variance and rebuild the vectors without error."""
    rep = RT.pca_report(fx.f_vec(spark, sf_dir), "embedding", k=10_000)
    return rep.select("vectors", r6("total_variance").alias("total_variance"), r6("kept_variance").alias("kept_variance"), F.abs(r6("mean_sq_error")).alias("mean_sq_error"))


@register("r6_pca_norms", with_("fvec", extra={**_R6_VARIANCE, "m": "SELECT i, avg(v) AS m FROM p GROUP BY i"}) + f"""
SELECT vec_id, {R6('sum((x - m) * (x - m))')} AS sq_norm
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM fvec) f JOIN m ON f.i = m.i GROUP BY vec_id""")
def r6_pca_norms(spark, sf_dir):
    """In all components a vector keeps its distance to the mean."""
    out = RT.pca_reduce(fx.f_vec(spark, sf_dir), "embedding", k=10_000)
    return out.select("vec_id", r6(F.aggregate("reduced", F.lit(0.0), lambda acc, v: acc + v * v)).alias("sq_norm"))


@register("r4_pair_dataset", with_("flog", extra={"r": """
SELECT query_id, llm, row_number() OVER (PARTITION BY query_id ORDER BY performance DESC NULLS LAST, pos) AS rn FROM flog"""}) + """
SELECT f.query_id, f.llm, CASE WHEN f.llm = r.llm THEN 1 ELSE 0 END AS label
FROM flog f JOIN r ON f.query_id = r.query_id AND r.rn = 1""")
def r4_pair_dataset(spark, sf_dir):
    f = fx.f_log(spark, sf_dir)
    recs = (f.groupBy("query_id").agg(
                F.min_by("query", "pos").alias("query"),
                L.first_argmax("llm", "performance", "pos").alias("ground_truth"),
                F.array_sort(F.collect_list(F.struct("pos", F.col("llm").alias("candidate_name")))).alias("candidates")))
    return RT.pair_dataset(recs).select("query_id", "llm", "label")


@register("g13_predicted_vs_golden", with_("fgrid", extra={"e": """
SELECT query_id, llm_idx * 2 + CAST(is_think AS INTEGER) AS idx,
       round((performance - cost / 100.0::DOUBLE) * 1000000.0) AS reward, round(cost * 1000000.0) AS cost,
       round(performance * 1000000.0) AS performance, -cost AS pred FROM fgrid""", "r": """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pred DESC, idx) AS rp,
          row_number() OVER (PARTITION BY query_id ORDER BY reward DESC, idx) AS rg FROM e"""}) + f"""
SELECT {R6('avg(reward) FILTER (WHERE rp = 1) / 1000000.0')} AS result_predict,
       {R6('avg(reward) FILTER (WHERE rg = 1) / 1000000.0')} AS result_golden,
       {R6('avg(cost) FILTER (WHERE rp = 1) / 1000000.0')} AS predict_cost,
       {R6('avg(performance) FILTER (WHERE rp = 1) / 1000000.0')} AS predict_performance FROM r""")
def g13_predicted_vs_golden(spark, sf_dir):
    """Features in integer micro-units, so sums (and means) are exact in any
    summation order; rescaled at the end."""
    g = fx.f_grid(spark, sf_dir)
    micro = lambda c: F.round(c * F.lit(1e6))
    e = g.select("query_id", (F.col("llm_idx") * 2 + F.col("is_think").cast("int")).alias("idx"),
                 micro(F.col("performance") - F.col("cost") / F.lit(100.0)).alias("reward"),
                 micro(F.col("cost")).alias("cost"), micro(F.col("performance")).alias("performance"),
                 (-F.col("cost")).alias("pred"))
    m = RT.predicted_vs_golden(e, "pred", "reward", pos="idx")
    return m.select(*[r6(F.col(c) / F.lit(1e6)).alias(c) for c in m.columns])


# ---------------------------------------------------------------- E10 -> S6/S5 -> R1 -> J8/G3, W9-W11
_CHAIN = {
    "rec": "SELECT split, query_id, llm, np AS performance, nc AS cost, score, rn FROM r WHERE scenario = 'balance'",
    "vec": "SELECT vec_id, embedding FROM fvec",
    "kn": """SELECT rec.split, rec.query_id, rec.llm AS best, vec.embedding FROM rec JOIN vec ON rec.query_id % (SELECT count(*) FROM vec) = vec.vec_id WHERE rn = 1""",
    "sim": """SELECT te.query_id AS qid, tr.query_id AS nid, tr.best, list_cosine_similarity(te.embedding, tr.embedding) AS sim
              FROM kn te, kn tr WHERE te.split = 'test' AND tr.split = 'train'""",
    "nb": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim * 1000000000.0) DESC, nid) AS rn FROM sim) t WHERE rn <= 20",
    "votes": "SELECT qid, best AS model, count(*) / 20.0::DOUBLE AS score FROM nb GROUP BY qid, best",
}


def _chain_sql(final: str) -> str:
    from routelake.plans.q_labels import _SCORES_SQL

    return with_("flog", "fvec").rstrip() + "," + _SCORES_SQL + ", " + ", ".join(f"{k} AS ({v})" for k, v in _CHAIN.items()) + final


def _chain(spark, sf_dir):
    """E10's records (scenario balance) by way of one JSON array; vectors repeat over the queries. A vector and its repetitions are equally
    near, so similarities are compared in nine digits."""
    import uuid

    from routelake.plans.q_labels import FIX_PATTERN
    from routelake.session import drop_stored, release, scratch_path
    from routelake.sources.json_array import read_json_array, write_json_array

    path, log_path = (scratch_path(spark, f"{name}-{uuid.uuid4().hex}") for name in ("records", "f-log"))
    log = fx.f_log_once(spark, sf_dir, log_path)
    release(spark)
    recs = L.route_records(log, FIX_PATTERN).where(F.col("scenario") == "balance").drop("scenario")
    write_json_array(recs, path, ["split", "query_id"], "gzip")
    back = read_json_array(spark, path, recs.schema)
    # The array is all that the routers read: the log and what was shuffled for it go.
    del log, recs
    drop_stored(spark, log_path)
    release(spark)
    v = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")  # as they are stored: copies of 4-byte floats are half as large
    n = v.count()
    vectors = back.select("query_id").withColumn("vec_id", F.col("query_id") % n).join(v, "vec_id").drop("vec_id")
    return RT.routing_frames(back, vectors)


@register("g3_router_from_records", _chain_sql(f""",
sc AS (SELECT rec.*, coalesce(votes.score, 0.0) AS vote FROM rec LEFT JOIN votes ON votes.qid = rec.query_id AND votes.model = rec.llm WHERE rec.split = 'test'),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vote DESC, llm) AS k FROM sc)
SELECT {R6('avg(performance)')} AS avg_performance, {R6('avg(cost)')} AS avg_cost, {R6('avg(score)')} AS avg_score, count(*) AS n_predicted FROM pr WHERE k = 1"""))
def g3_router_from_records(spark, sf_dir):
    """The whole way: E10's records, written and read back, train a nearest-neighbour router, and its choices are scored."""
    train, test, cand = _chain(spark, sf_dir)
    rep = RT.router_report(RT.predicted_outcomes(RT.knn_router(train, test, cand, k=20), cand))
    return rep.select(r6("avg_performance").alias("avg_performance"), r6("avg_cost").alias("avg_cost"), r6("avg_score").alias("avg_score"), "n_predicted")


@register("w9_router_ranking", _chain_sql(f""",
al AS (SELECT kn.query_id, m.best AS model, coalesce(votes.score, 0.0) AS score, kn.best AS truth FROM kn JOIN (SELECT DISTINCT best FROM kn WHERE split = 'train') m ON kn.split = 'test'
       LEFT JOIN votes ON votes.qid = kn.query_id AND votes.model = m.best),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, model) AS rank FROM al)
SELECT query_id, {R6('coalesce(max(CASE WHEN model = truth AND rank <= 5 THEN 1.0 / log2(rank + 1.0) END), 0.0)')} AS ndcg_at_k,
       max(CASE WHEN model = truth AND rank <= 5 THEN 1 ELSE 0 END)::DOUBLE AS hit_at_k, {R6('coalesce(max(CASE WHEN model = truth THEN 1.0 / rank END), 0.0)')} AS mrr
FROM rk GROUP BY query_id"""))
def w9_router_ranking(spark, sf_dir):
    """W9-W11 of the router's ranked models: where the true best model stands."""
    train, test, _ = _chain(spark, sf_dir)
    ranked = RT.ranked_models(RT.knn_scores(train, test, 20), test, train.select(F.col("ground_truth").alias("model")))
    m = RT.ranking_quality(ranked, test, 5)
    return m.select("query_id", r6("ndcg_at_k").alias("ndcg_at_k"), "hit_at_k", r6("mrr").alias("mrr"))
