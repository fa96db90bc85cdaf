"""Routers over the log: kNN vote (R1), linear / MLP (R2 R3), pair data (R4),
embedding similarity (R5), PCA (R6); evaluation J7 J8 G3 G12 G13.

Inputs use a flat routing layout:
- ``train``: one row per training query with its vector and best model
  (``query_id, embedding, ground_truth``);
- ``test``: one row per test query (``query_id, embedding``);
- ``candidates``: one row per (test query, candidate model) with the
  candidate's ``performance, cost, score``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelake.functions.numeric import cosine, dot
from routelake.operators.common import join_dim, small_rows
from routelake.operators.moments import Components, linear_weights, moments, project
from routelake.operators.vectors import _usable, elementwise_mean, knn_topk


MAX_MODELS = 10_000  # names of a catalogue that a plan may hold


def routing_frames(records: DataFrame, vectors: DataFrame, qid: str = "query_id", vec: str = "embedding", split: str = "split"):
    """The routers' inputs from E10's nested records: (train, test, candidates) with ``train(query_id, embedding, ground_truth)``,
    ``test(query_id, embedding, true_model)`` and a row per test query and candidate with its performance, cost and score.
    Queries without a vector are left out of both sides."""
    known = records.select(qid, split, F.col("ground_truth")).join(vectors.select(qid, vec), qid)
    train = known.where(F.col(split) == "train").select(qid, vec, "ground_truth")
    test = known.where(F.col(split) == "test").select(qid, vec, F.col("ground_truth").alias("true_model"))
    cand = records.where(F.col(split) == "test").select(qid, F.explode("candidates").alias("c")).select(qid, "c.*")
    return train, test, cand


def ranked_models(votes: DataFrame, queries: DataFrame, models: DataFrame, qid: str = "query_id") -> DataFrame:
    """All routable models of each query in the router's order (query_id, model, score, rank): models without votes score 0, ties
    go to the alphabetically first.  ``models(model)`` is the catalogue's list of at most ``MAX_MODELS`` names (more raise)."""
    names = sorted(r["model"] for r in small_rows(models.select("model").where("model is not null").distinct(), MAX_MODELS))
    named = queries.select(qid).withColumn("__all", F.array(*[F.lit(m) for m in names]).cast("array<string>"))
    all_scores = (named.select(qid, F.explode("__all").alias("model")).join(votes, [qid, "model"], "left")
                  .withColumn("score", F.coalesce("score", F.lit(0.0))))
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col("model"))
    return all_scores.withColumn("rank", F.row_number().over(w))


def ranking_quality(ranked: DataFrame, truth: DataFrame, k: int, qid: str = "query_id", true_model: str = "true_model") -> DataFrame:
    """W9-W11 of ``ranked_models``: NDCG@k, Hit@k and MRR per query, the true best model being the only relevant one."""
    from routelake.operators.ranking import ranking_metrics

    x = ranked.join(truth.select(qid, true_model), qid).withColumn("rel", (F.col("model") == F.col(true_model)).cast("int"))
    return ranking_metrics(x.withColumn("__place", -F.col("rank")), qid, "__place", "rel", k, pos="rank")


def route_models(train_candidates: DataFrame, name: str = "candidate_name") -> DataFrame:
    """G9 as a table: distinct candidate names seen in training (``model``)."""
    return train_candidates.select(F.col(name).alias("model")).distinct()


def restrict_to_available(pred_scores: DataFrame, candidates: DataFrame,
                          qid: str = "query_id", model: str = "model") -> DataFrame:
    """Keep (query, model) scores only where the model is a candidate of that query."""
    avail = candidates.select(F.col(qid).alias(qid), F.col("candidate_name").alias(model))
    return pred_scores.join(avail, [qid, model], "left_semi")


def pick_best(scores: DataFrame, qid: str = "query_id", model: str = "model", score: str = "score") -> DataFrame:
    """Argmax model per query; ties go to the alphabetically first model."""
    w = Window.partitionBy(qid).orderBy(F.col(score).desc_nulls_last(), F.col(model))
    return (scores.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
                  .select(qid, F.col(model).alias("predicted"), F.col(score).alias("predicted_score")))


def knn_scores(train: DataFrame, test: DataFrame, k: int = 50, qid: str = "query_id",
               vec: str = "embedding", label: str = "ground_truth") -> DataFrame:
    """R1 neighbour vote: share of the k nearest training queries (cosine)
    whose best model is each label.  Returns ``(query_id, model, score)`` for
    labels that received votes."""
    nb = knn_topk(test, train, k, qid, vec, qid, vec, extra_cols=[label])
    # One branch over the neighbours: votes per (query, label), then the
    # share via a window over the (small) per-query vote rows, so the kNN
    # cogroup is not evaluated twice.
    v = nb.groupBy("qid", label).agg(F.count(F.lit(1)).alias("__c"))
    total = F.sum("__c").over(Window.partitionBy("qid"))
    return v.select(F.col("qid").alias(qid), F.col(label).alias("model"), (F.col("__c") / total).alias("score"))


def knn_router(train: DataFrame, test: DataFrame, candidates: DataFrame, k: int = 50,
               models: DataFrame | None = None, qid: str = "query_id", vec: str = "embedding",
               label: str = "ground_truth") -> DataFrame:
    """Predicted model per test query.

    Every routable model that is a candidate of the query gets its vote share
    (0 when no neighbour chose it); the best share wins, ties to the
    alphabetically first model.  Queries with no routable candidate are
    dropped (the reference skips them).
    """
    votes = knn_scores(train, test, k, qid, vec, label)
    avail = candidates.select(F.col(qid), F.col("candidate_name").alias("model"))
    if models is not None:
        avail = join_dim(avail, models.select("model").distinct(), "model", "left_semi")
    scored = (avail.join(votes, [qid, "model"], "left")
                   .withColumn("score", F.coalesce(F.col("score"), F.lit(0.0))))
    return pick_best(scored, qid)


def predicted_outcomes(pred: DataFrame, candidates: DataFrame, qid: str = "query_id") -> DataFrame:
    """The predicted candidate's performance / cost / score."""
    c = candidates.select(qid, F.col("candidate_name").alias("predicted"), "performance", "cost", "score")
    return pred.join(c, [qid, "predicted"])


def router_report(outcomes: DataFrame) -> DataFrame:
    """Mean performance, cost, score of the chosen models; 0.0 if none."""
    return outcomes.agg(
        F.coalesce(F.avg("performance"), F.lit(0.0)).alias("avg_performance"),
        F.coalesce(F.avg("cost"), F.lit(0.0)).alias("avg_cost"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        F.count(F.lit(1)).alias("n_predicted"))


def accuracy_macro_f1(pred: DataFrame, truth: DataFrame, qid: str = "query_id",
                      p: str = "predicted", t: str = "true_model") -> DataFrame:
    """Accuracy and macro-F1 (rows ``metric, value``) of predicted vs true argmax labels.

    F1 is averaged over every class present on either side (precision or
    recall with an empty denominator count as 0).  Each (query) row
    contributes one "predicted" and one "true" record per class through one
    explode, so per-class counts, accuracy and macro-F1 come from a single
    pass over the predictions (which may be expensive, e.g. kNN)."""
    x = pred.select(qid, p).join(truth.select(qid, t), qid)
    hit = (F.col(p) == F.col(t)).cast("long")
    rec = F.explode(F.array(
        F.struct(F.col(p).alias("cls"), F.lit(1).cast("long").alias("np"), hit.alias("tp"), F.lit(0).cast("long").alias("nt")),
        F.struct(F.col(t).alias("cls"), F.lit(0).cast("long").alias("np"), F.lit(0).cast("long").alias("tp"),
                 F.lit(1).cast("long").alias("nt"))))
    per = x.select(rec.alias("r")).groupBy(F.col("r.cls").alias("cls")).agg(
        F.sum("r.np").alias("np"), F.sum("r.tp").alias("tp"), F.sum("r.nt").alias("nt"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("np").cast("double")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("nt").cast("double")), F.lit(0.0))
    f1 = F.when(prec + recall > 0, F.lit(2.0) * prec * recall / (prec + recall)).otherwise(F.lit(0.0))
    both = per.agg((F.sum("tp") / F.sum("np")).alias("accuracy"), F.avg(f1).alias("macro_f1"))
    return both.selectExpr("stack(2, 'accuracy', accuracy, 'macro_f1', macro_f1) as (metric, value)")


def predicted_vs_golden(edges: DataFrame, pred_score: str, reward: str = "reward", qid: str = "query_id",
                        pos: str = "llm_idx", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Mean reward at the predicted argmax, at the true argmax, and mean
    (cost, performance) at the predicted argmax; optional candidate range
    ``[lo, hi)`` on ``pos``.  First index wins ties, as ``argmax`` does."""
    e = edges
    if lo is not None:
        e = e.where((F.col(pos) >= lo) & (F.col(pos) < hi))
    g = e.groupBy(qid).agg(
        F.max_by(F.struct(reward, "cost", "performance"), F.struct(F.col(pred_score), -F.col(pos))).alias("__p"),
        F.max_by(F.col(reward), F.struct(F.col(reward), -F.col(pos))).alias("__g"))
    return g.agg(F.avg("__p." + reward).alias("result_predict"), F.avg("__g").alias("result_golden"),
                 F.avg("__p.cost").alias("predict_cost"), F.avg("__p.performance").alias("predict_performance"))


def pair_dataset(records: DataFrame, qid: str = "query_id") -> DataFrame:
    """Explode nested candidates to (query, model, label = model is the best)."""
    x = records.select(qid, "query", "ground_truth", F.explode("candidates").alias("c"))
    return x.select(qid, "query", F.col("c.candidate_name").alias("llm"),
                    (F.col("c.candidate_name") == F.col("ground_truth")).cast("int").alias("label"))


def centroid_router(train: DataFrame, test: DataFrame, candidates: DataFrame, qid: str = "query_id",
                    vec: str = "embedding", label: str = "ground_truth", digits: int | None = 9) -> DataFrame:
    """Rank each query's candidates by cosine(query, model vector); the
    model vector is the centroid of the training queries it won.  The
    centroid table has one row per model (bounded), joined after a size check."""
    cent = elementwise_mean(train, label, vec, "model_vec", digits).withColumnRenamed(label, "model")
    c = candidates.select(qid, F.col("candidate_name").alias("model"))
    x = join_dim(c, cent, "model").join(test.select(qid, F.col(vec).alias("__q")), qid)
    s = x.select(qid, "model", cosine(F.col("__q").cast("array<double>"), "model_vec").alias("score"))
    return pick_best(s.where(F.col("score").isNotNull()), qid)


def linear_router(train: DataFrame, test: DataFrame, candidates: DataFrame, models=None, qid: str = "query_id",
                  vec: str = "embedding", label: str = "ground_truth", ridge: float = 0.01) -> DataFrame:
    """R2: a ridge regression per model on 0/1 "is best" targets; the highest prediction among a query's
    available candidates wins.  One scan of ``train`` sums the normal equations of all models at once and one
    solve gives their weights (``moments``); the weight table has one row per model.  ``models``: the models to
    train (default: every label of ``train``); a vector of another length than the weights' has no prediction."""
    m = moments(train, vec, label)
    fitted = linear_weights(m, sorted(m.labels) if models is None else models, ridge) if m else {}
    spark = train.sparkSession
    weights = spark.createDataFrame([(k, w.tolist()) for k, w in fitted.items()], "model string, weights array<double>")
    x = join_dim(candidates.select(qid, F.col("candidate_name").alias("model")), weights, "model")
    x = x.join(test.select(qid, F.col(vec).cast("array<double>").alias("__x")), qid)
    bias, w = F.element_at("weights", 1), F.slice("weights", 2, F.size("weights"))
    score = F.when(_usable("__x") & (F.size("__x") == F.size(w)), bias + dot("__x", w))
    return pick_best(x.select(qid, "model", score.alias("score")).where(F.col("score").isNotNull()), qid)


def mlp_router(train: DataFrame, test: DataFrame, candidates: DataFrame, models, qid: str = "query_id",
               vec: str = "embedding", label: str = "ground_truth", hidden: int = 16, max_iter: int = 30,
               seed: int = 1234) -> DataFrame:
    """R3 (re-aimed): one ``MultilayerPerceptronClassifier`` over all models;
    class probabilities are the per-model scores."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    idx = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(float(i)))])
    tr = train.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"),
                      idx[F.col(label)].alias("y")).where(F.col("y").isNotNull())
    dim = len(train.select(vec).first()[0])
    mlp = MultilayerPerceptronClassifier(layers=[dim, hidden, len(models)], maxIter=max_iter, seed=seed,
                                         labelCol="y", featuresCol="features")
    fit = mlp.fit(tr)
    te = test.select(qid, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    prob = fit.transform(te).select(qid, vector_to_array("probability").alias("p"))
    names = F.array(*[F.lit(m) for m in models])
    scores = prob.select(qid, F.posexplode("p").alias("i", "score")).select(
        qid, F.element_at(names, F.col("i") + 1).alias("model"), "score")
    return pick_best(restrict_to_available(scores, candidates, qid), qid)


def pca_reduce(df: DataFrame, vec: str = "embedding", k: int = 50, out: str = "reduced") -> DataFrame:
    """Centred vectors projected onto the top-``k`` principal components (all, if fewer).  The covariance comes from
    one scan of mergeable moments; signs follow a fixed rule (``moments.Components``)."""
    m = moments(df, vec)
    if m is None:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    return project(df, vec, Components(m, k), out)


def pca_report(df: DataFrame, vec: str = "embedding", k: int = 50) -> DataFrame:
    """R6 quality, one row: vectors, total_variance, kept_variance of the top-``k`` components, and mean_sq_error of
    rebuilding the vectors from them (measured on the vectors, times n / (n - 1): total minus kept)."""
    m = moments(df, vec)
    if m is None:
        return df.sparkSession.createDataFrame([], "vectors long, total_variance double, kept_variance double, mean_sq_error double")
    c = Components(m, k)
    mean = F.array(*[F.lit(float(x)) for x in c.mean])
    centred = F.zip_with(F.col(vec).cast("array<double>"), mean, lambda a, b: a - b)
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)
    x = project(df, vec, c, "__r").where(F.col("__r").isNotNull())
    n = F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
    return x.agg(F.count(F.lit(1)).alias("vectors"), (F.sum(square(centred)) / n).alias("total_variance"), (F.sum(square(F.col("__r"))) / n).alias("kept_variance"),
                 (F.sum(square(centred) - square(F.col("__r"))) / n).alias("mean_sq_error"))
