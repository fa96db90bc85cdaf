"""Pairwise quality ranking: the fit against plain gradient descent, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelake.llm import quality
from routelake.llm.queries import QUERIES


def test_fit_minimises_the_pairwise_loss():
    r = np.random.RandomState(1)
    x = r.randn(40, 4)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * r.randn(40) > 0.4).astype(int)
    w = quality.fit(x, y)
    a, b = quality._difference_pairs(x[y == 1], x[y == 0])
    d = x[y == 1][a] - x[y == 0][b]
    v = np.zeros(4)
    for _ in range(20000):
        v -= 0.2 * (-(d / (1 + np.exp(d @ v))[:, None]).mean(axis=0) + 2 * quality.RIDGE * v)
    assert np.allclose(w, v, atol=1e-4)


def test_every_document_is_compared():
    a, b = quality._difference_pairs(np.zeros((50, 1)), np.zeros((7, 1)))
    assert set(a.tolist()) == set(range(50)) and set(b.tolist()) == set(range(7))
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a)


def test_threshold_is_the_quantile_of_the_share():
    assert quality.quantile_threshold(np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4), 0.25) == 1.5
    assert quality.quantile_threshold(np.array([1.0, 5.0]), np.array([9.0, 1.0]), 0.9) == 3.0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op13_quality"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = out.join(labels, "doc_id").where("held_out")
    n, right = held.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 100 and right / n > 0.95
    assert out.where("score < 0 or score > 1 or predicted <> int(score >= 0.5)").isEmpty()


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(1, "Good words here.", 1.0), (1, "Good words here.", 1.0), (2, None, 0.0), (3, "", 0.0), (None, "BAD!! BAD!!", 0.0), (4, "z" * 100_000, 0.0),
                                  (5, "\ud800".encode("utf-8", "replace").decode(), 0.0)], "doc_id long, text string, score double")


def test_odd_rows_and_clashing_columns(spark, odd):
    labels = spark.createDataFrame([(1, 1, "a"), (3, 0, "b"), (4, 0, None), (5, None, "c"), (None, 0, "d"), (2, 7, "e"), (6, 0, "f"), (6, 1, "g")],
                                   "doc_id long, quality int, text string")
    model = quality.train(odd.withColumn("quality", F.lit(9)), labels)
    out = quality.classify(odd.withColumn("_text0", F.lit("keep")), model)
    assert out.columns == ["doc_id", "text", "_text0", "score", "predicted"] and out.count() == 7
    scores = {(r["doc_id"], r["text"]): r["score"] for r in out.collect()}
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores.values())
    assert scores[2, None] == scores[3, ""] and scores[1, "Good words here."] >= 0.5


def test_without_labels_and_without_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(odd, none)
    assert {r["score"] for r in quality.classify(odd, model).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert {round(r["score"], 6) for r in quality.classify(odd, quality.train(odd, ones)).collect()} == {0.75}
    assert quality.classify(odd.where("false"), model).count() == 0


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    """Many blocks and few scores at once: the model of all rows, with the threshold at the exact quantile."""
    monkeypatch.setattr(quality, "BLOCK_ROWS", 50)
    monkeypatch.setattr(quality, "RANGE_ROWS", 10)
    monkeypatch.setattr(quality, "BINS", 4)
    r = np.random.RandomState(2)
    rows = [(i, " ".join("".join(r.choice(list("abc!#"), 4)) if i % 4 else "plain words" for _ in range(5 + i % 7)), 1 if i % 4 == 0 else 0) for i in range(400)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    model = quality.train(docs, labels)
    x, y = np.array([quality.features(t) for _, t, _ in rows]), np.array([q for *_, q in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    raw = model.raw(x)
    assert abs(model.threshold - quality.quantile_threshold(raw, np.ones(400), 0.75)) < 1e-9
    assert ((raw > model.threshold) == (y == 1)).all()


def test_threshold_by_counting(spark, monkeypatch):
    monkeypatch.setattr(quality, "RANGE_ROWS", 5)
    monkeypatch.setattr(quality, "BINS", 3)
    r = np.random.RandomState(3)
    for values in (r.randn(200), np.round(r.randn(200), 1), np.repeat([1.0, 2.0], 100), np.ones(50)):
        y = r.randint(0, 2, len(values))
        df = spark.createDataFrame([(int(q), float(v)) for q, v in zip(y, values)], "quality int, raw double")
        for share in (0.1, 0.5, 0.9):
            assert quality.scores_threshold(df, (1.0, 1.0), share) == quality.quantile_threshold(values, np.ones(len(values)), share)
