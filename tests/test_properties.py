"""Hand-worked literal cases and invariants of the Column expressions."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from routelake.functions import text as T
from routelake.operators import batch as B
from routelake.operators import ranking as R
from routelake.operators import scoring as S
from routelake.operators.vectors import knn_topk

WORDS = ["a", "an", "the", "The", "A", "cat", "dog's", "yes", "no", "noanswer", "x-y", "42", "3.5", "naïve",
         "Über", "end.", "(b)", "don't", "", "  ", "\t", "\n", "!!", "the.", "an,"]
text = st.lists(st.sampled_from(WORDS), min_size=0, max_size=12).map(lambda ws: " ".join(ws))


# Worked by hand: text, normalised text.
NORMAL = [
    ("The cat's  A hat.", "cats hat"), ("an the a", ""), ("Über naïve!", "über naïve"), ("x-y 3.5", "xy 35"), ("theory another", "theory another"),
    ("\u201cThe answer\u201d", "\u201c answer\u201d"), ("the\u2014end a.", "\u2014end"), ("l\u2019a the\u0301", "l\u2019 the\u0301"), ("", ""), (" \t\n", ""),
]

# Worked by hand: prediction, truth, F1, exact match, contains match.
SCORED = [
    ("the cat sat", "cat", 2 * (1 / 2) * 1 / (1 / 2 + 1), 0.0, 1.0),
    ("Yes", "yes", 1.0, 1.0, 1.0),
    ("yes indeed", "yes", 0.0, 0.0, 1.0),
    ("red red blue", "red blue blue", 2 / 3, 0.0, 0.0),
    ("dog", "cat", 0.0, 0.0, 0.0),
]


def test_normalize_literals(spark):
    df = spark.createDataFrame(NORMAL, "s string, want string")
    for r in df.select("s", "want", T.normalize_answer("s").alias("got")).collect():
        assert r.got == r.want, r.s


def test_score_literals(spark):
    df = spark.createDataFrame(SCORED, "p string, g string, f1 double, em double, cem double")
    got = df.select("*", S.token_f1("p", "g")["f1"].alias("f"), S.exact_match("p", "g").alias("e"), S.contains_match("p", "g").alias("c")).collect()
    for r in got:
        assert math.isclose(r.f, r.f1, abs_tol=1e-12) and r.e == r.em and r.c == r.cem, (r.p, r.g)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(text, text), min_size=1, max_size=30))
def test_score_invariants(spark, pairs):
    """A text matches itself, F1 is symmetric and at most 1, and an exact match is a contained one."""
    df = spark.createDataFrame(pairs, "p string, g string")
    cols = [T.normalize_answer("p").alias("n"), S.token_f1("p", "g")["f1"].alias("a"), S.token_f1("g", "p")["f1"].alias("b"),
            S.exact_match("p", "g").alias("em"), S.exact_match("p", "p").alias("self"), S.contains_match("p", "g").alias("cem")]
    for r in df.select(*cols).collect():
        assert r.self == 1.0 and 0.0 <= r.a <= 1.0 and math.isclose(r.a, r.b, abs_tol=1e-12) and r.cem >= r.em
        assert not {"a", "an", "the", ""} & set(r.n.split(" ")) or r.n == ""


def py_pass_at_k(n, c, k):
    if n - c < k:
        return 1.0
    prod = 1.0
    for i in range(n - c + 1, n + 1):
        prod *= 1.0 - k / i
    return 1.0 - prod


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 30)), min_size=10, max_size=40))
def test_pass_at_k(spark, nc):
    rows = [(n, min(c, n)) for n, c in nc]
    df = spark.createDataFrame(rows, "n int, c int")
    for k in (1, 5):
        got = df.select("n", "c", R.pass_at_k_per_problem("n", "c", k).alias("p")).collect()
        for r in got:
            assert math.isclose(r["p"], py_pass_at_k(r["n"], r["c"], k), abs_tol=1e-12)


def test_gsm8k_extraction(spark):
    rows = [("so 1,234 apples", "#### 1234", 1.0), ("x 12.0", "#### 120", 1.0), ("none", "#### 3", 0.0),
            ("a . b", "#### 5", 0.0), ("-7 then .", "#### -7", 1.0)]
    df = spark.createDataFrame(rows, "p string, g string, want double")
    for r in df.select("want", S.gsm8k_score("p", "g").alias("got")).collect():
        assert r["got"] == r["want"]


def test_choice_match(spark):
    rows = [("I pick (B) then ( c )", "c", 1.0), ("answer (A)", "B", 0.0), ("no letter", "", 1.0), ("(a)", " A ", 1.0)]
    df = spark.createDataFrame(rows, "p string, g string, want double")
    for r in df.select("want", S.choice_match("p", "g").alias("got")).collect():
        assert r["got"] == r["want"]


# Worked by hand: query, task, key.
KEYS = [
    ("What is 2+2?\nLet's think step by step.", "math", "What is 2+2?"),
    ("What is 2+2? LET'S THINK STEP BY STEP", "math", "What is 2+2?"),
    ("lets think step by step", "math", "lets think step by step"),
    ("Is  it\n so? lets think step by step. ", "boolq", "Is it so?"),
    ("Let's think step by step. Why?", "math", "Let's think step by step. Why?"),
    ("", "boolq", ""),
]


def test_query_keys(spark):
    df = spark.createDataFrame(KEYS, "q string, t string, want string")
    for r in df.select("q", "want", T.strip_think_suffix("q", "t").alias("got")).collect():
        assert r.got == r.want, r.q


def test_a_metric_registered_late_counts(spark):
    df = spark.createDataFrame([("x", "y", "own_metric", "t")], "prediction string, ground_truth string, metric string, task_name string")
    assert df.select(S.score_by_metric()).first()[0] == 0.0
    S.register_metric("own_metric", lambda p, g: F.lit(0.25))
    assert df.select(S.score_by_metric()).first()[0] == 0.25


def test_neighbours_skip_null_and_nan_vectors(spark):
    items = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 1.0]), (5, [None, 1.0])]
    df = spark.createDataFrame(items, "id long, v array<double>")
    got = knn_topk(df, df.selectExpr("id as i", "v as w"), 3, "id", "v", "i", "w").collect()
    assert sorted((r.qid, r["rank"], r.iid) for r in got) == [(1, 1, 1), (1, 2, 4), (4, 1, 4), (4, 2, 1)]


def test_retry_takes_the_newest_attempt(spark):
    done = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("c", 1, False)], "k string, run int, success boolean")
    work = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert sorted(r.k for r in B.pending_work(work, done, "k", retry_failed=True, order="run").collect()) == ["b", "c"]
