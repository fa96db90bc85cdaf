"""The model's probabilities against an exact small case: where every word occurs once, every seating is certain."""

import math

import pytest
from pyspark.sql import functions as F

from routelake.llm import pitman_yor as P

TRAIN = "a b c d e".split()


def exact(words):
    """log10 probability of a text: interpolated Pitman-Yor estimates with one customer and one table for each training pair."""
    known = [*TRAIN, None]  # None: the end
    pairs = set(zip([0, *TRAIN], known))
    base = 1 / (len(known) + 1)
    n = len(known)

    def root(w):
        seen = w in known
        return ((1 - P.ROOT_DISCOUNT) * seen + (P.ROOT_STRENGTH + P.ROOT_DISCOUNT * n) * base) / (P.ROOT_STRENGTH + n)

    total, before = 0.0, 0
    for w in [*words, None]:
        has = before == 0 or before in TRAIN  # a context seen in training has one customer
        p = ((1 - P.DISCOUNT) * ((before, w) in pairs) + (P.STRENGTH + P.DISCOUNT * has) * root(w)) / (P.STRENGTH + has)
        total += math.log10(p)
        before = w
    return total


def test_scores_equal_the_exact_model(spark):
    texts = ["a b c d e", "a b", "b a", "x y z", "a x b c", "", "e", "c d e a b", "A B"]
    rows = [(0, " ".join(TRAIN), False)] + [(i + 1, t, True) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in P.score(spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3), F.col("held")).collect()}
    for i, t in enumerate(texts):
        assert got[i + 1].score == pytest.approx(exact(t.lower().split()), abs=1e-5)
        assert got[i + 1].n_known == sum(w in TRAIN for w in t.lower().split()) + 1
    assert got[0].score == pytest.approx(exact(TRAIN), abs=1e-5)


def test_probabilities_of_all_first_words_sum_to_one():
    """The vocabulary, the end and one unknown word, by the formula that the scores are held against."""
    def end_after(w):
        return exact([w]) - first(w)

    def first(w):
        n, base = 6, 1 / 7
        root = ((1 - P.ROOT_DISCOUNT) * (w != "unknown") + (P.ROOT_STRENGTH + P.ROOT_DISCOUNT * n) * base) / (P.ROOT_STRENGTH + n)
        return math.log10(((1 - P.DISCOUNT) * (w == "a") + (P.STRENGTH + P.DISCOUNT) * root) / (P.STRENGTH + 1))

    assert sum(10 ** first(w) for w in [*TRAIN, "unknown"]) + 10 ** exact([]) == pytest.approx(1.0)
    assert all(end_after(w) < 0 for w in TRAIN) and end_after("e") > end_after("a")
