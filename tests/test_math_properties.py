"""Math answers (T19, T20, E7): hand-worked literal cases, and invariants on random strings."""

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from routelake.functions import mathtext as M

BOXED = [
    ("so \\boxed{4}", "\\boxed{4}"),
    ("\\boxed{1} then \\boxed{\\frac{1}{2}}.", "\\boxed{\\frac{1}{2}}"),
    ("\\fbox{x}", "\\fbox{x}"),
    ("nothing here", None),
    ("\\boxed{never closed", None),
]

CANONICAL = [
    ("\\boxed{4}", "4"),
    ("\\boxed{x = 5}", "5"),
    ("\\boxed{0.5}", "\\frac{1}{2}"),
    ("\\boxed{3/4}", "\\frac{3}{4}"),
    ("\\boxed{\\frac12}", "\\frac{1}{2}"),
    ("\\boxed{\\dfrac{1}{2}}", "\\frac{1}{2}"),
    ("\\boxed{50\\%}", "50"),
    ("\\boxed{\\sqrt3}", "\\sqrt{3}"),
    ("\\boxed{ 1 2 }", "12"),
]

SCORES = [
    ("it is \\boxed{\\frac12}", "so \\boxed{1/2}", 1.0),
    ("it is \\boxed{0.5}", "so \\boxed{\\frac{1}{2}}", 1.0),
    ("it is \\boxed{3}", "so \\boxed{4}", 0.0),
    ("no box", "so \\boxed{4}", 0.0),
]


@pytest.mark.parametrize("text,want", BOXED)
def test_last_boxed(spark, text, want):
    assert spark.createDataFrame([(text,)], "p string").select(M.last_boxed("p")).first()[0] == want


def test_canonical_and_score(spark):
    df = spark.createDataFrame(CANONICAL, "p string, want string")
    got = df.select("want", M.canonical_answer(M.remove_boxed(M.last_boxed("p"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    df = spark.createDataFrame(SCORES, "p string, g string, want double")
    got = df.select("want", M.math_score("p", "g").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


PIECES = ["\\boxed{", "\\fbox{", "}", "{", "\\frac", "12", "x = ", " ", "1/2", "\\sqrt", "\\%", "$", "é", "7"]


@settings(max_examples=3, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=10).map("".join), min_size=20, max_size=40))
def test_invariants(spark, texts):
    """What is found lies in the text and closes its braces; a text scores 1 against itself, and NULL exactly where it
    holds no usable boxed answer."""
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    boxed = M.last_boxed("p")
    for r in df.select("p", boxed.alias("b"), M.remove_boxed(boxed).alias("u"), M.math_score("p", "p").alias("s")).collect():
        assert r.s == (None if r.u is None else 1.0)
        if r.b is not None:
            assert r.b in r.p and r.b.count("{") == r.b.count("}")
