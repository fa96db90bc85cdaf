"""Hand-checked literal cases: prompts, math answers, judge replies, vectors."""

from pyspark.sql import functions as F

from routelake.functions import mathtext as M
from routelake.functions import numeric as N
from routelake.functions import prompts as P
from routelake.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_qa_prompt(spark):
    got = one(spark, P.qa_prompt(F.lit("CTX"), F.lit("Q?")))
    assert got == (" Use the following context to answer the question.\n        ## Context:\n        CTX\n\n"
                   "        ## Question:\n        Q?\n        ")
    think = one(spark, P.qa_prompt(F.lit("CTX"), F.lit("Q?"), True))
    assert think.endswith("Q?\n        \nLet's think step by step.\n        ")


def test_choice_prompt(spark):
    got = one(spark, P.choice_prompt(F.lit("Why?"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("x"), F.lit("y"))))
    assert got.endswith("Question: Why? \n\n        \n(A) x\n(B) y")


def test_mc_and_math_prompt(spark):
    mc = one(spark, P.mc_prompt(F.lit("Q"), F.array(F.lit("p"), F.lit("q"))))
    assert mc.endswith("## Question:\nQ\n\n## Options:\nA. p\nB. q\n\n")
    math = one(spark, P.math_prompt(F.lit("1+1")))
    assert "inside \\boxed{}." in math and math.endswith("Question: 1+1\n        ")


def test_math_answers(spark):
    cases = [("The answer is \\boxed{\\frac12}.", "so \\boxed{\\frac{1}{2}}", 1.0),
             ("\\boxed{0.5}", "\\boxed{\\frac{1}{2}}", 1.0), ("x \\boxed 5$ y", "\\boxed{5}", 1.0),
             ("\\fbox{3}", "\\boxed{3}", 0.0), ("no box", "\\boxed{3}", 0.0), ("\\boxed{3/4}", "\\boxed{\\frac{3}{4}}", 1.0),
             ("\\boxed{a/b}", "\\boxed{a/b}", 1.0), ("\\boxed{x = 10\\%}", "\\boxed{10}", 1.0),
             ("\\boxed{{1}", "\\boxed{1}", 0.0), ("\\boxed{\\dfrac{\\sqrt3}{2}}", "\\boxed{\\frac{\\sqrt{3}}{2}}", 1.0),
             ("\\boxed{2}", "nothing", None), ("\\boxed{01/2}", "\\boxed{\\frac{1}{2}}", 0.0)]
    df = spark.createDataFrame(cases, "p string, g string, want double")
    for r in df.select("want", M.math_score("p", "g").alias("got")).collect():
        assert r["got"] == r["want"]


def test_canonical_failures_are_null(spark):
    df = spark.createDataFrame([("\\sqrt",), ("\\text{ a}\\text{ b}",), ("a/b",), ("\\frac",), ("\\frac1",)], "s string")
    got = [r[0] for r in df.select(M.canonical_answer("s")).collect()]
    assert got == [None, None, None, None, "\\frac1"]


def test_judge_score(spark):
    rows = [("<answer>0.8</answer>", 0.8), ("<answer> 7 </answer>", 1.0), ("<answer>-1</answer>", 0.0),
            ("<answer>abc</answer>", None), ("no tags", None), ("<answer>\n0.5</answer>", None)]
    df = spark.createDataFrame(rows, "r string, want double")
    for r in df.select("want", N.judge_score("r").alias("got")).collect():
        assert r["got"] == r["want"]


def test_lenient_double(spark):
    rows = [("0.25", 0.25), ("{'pass@1': 0.5}", 0.5), ("np.float64(0.3)", None), (" 4 ", 4.0),
            ("1d", None), ("nan", None), ("{'pass@1': np.float64(0.75)}", 0.75)]
    df = spark.createDataFrame(rows, "v string, want double")
    for r in df.select("want", N.lenient_double("v").alias("got")).collect():
        assert r["got"] == r["want"]


def test_parse_vector_and_cosine(spark):
    df = spark.createDataFrame([("tensor([1.0, 2.0, -3e-1], device='cuda:0')", "[0, 0, 0]")], "a string, b string")
    r = df.select(N.parse_vector("a").alias("a"), N.cosine(N.parse_vector("a"), N.parse_vector("b")).alias("c")).first()
    assert r["a"] == [1.0, 2.0, -0.3] and r["c"] == 0.0


def test_think_suffix_and_brackets(spark):
    df = spark.createDataFrame([("Is it?\nLet's think step by step.", "boolq"), ("Q  A \n let's THINK step by step", "x")],
                               "q string, t string")
    got = [r[0] for r in df.select(T.strip_think_suffix("q", "t")).collect()]
    assert got == ["Is it?", "Q  A"]
    assert one(spark, T.clean_brackets(F.lit("  A [title] B [x]c  "))) == "A. B c"


def test_capitalize_titlecases_first_character(spark):
    words = ["ßaB", "éTÉ", "ﬁne", "ǆungla", "hello WORLD", ""]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert [r[0] for r in df.select(T.capitalize("s")).collect()] == [w.capitalize() for w in words]


def test_every_metric_has_hits_misses_and_nulls(spark):
    from routelake.operators.scoring import score_by_metric
    from routelake.plans.q_assemble import _scored_input

    score = score_by_metric("prediction", "ground_truth", "metric", "task_name", code_pass="code_pass")
    rows = _scored_input(spark, "/root/testdata/sf0.01").select("metric", "task_name", score.alias("score")).collect()
    seen = {}
    for r in rows:
        seen.setdefault(r.metric, set()).add(r.score)
    assert {m for m, s in seen.items() if len(s - {None}) > 1} == {"em", "cem", "em_mc", "GSM8K", "MATH", "f1_score", "code_eval"}
    assert len({r.task_name for r in rows}) == 14 and any(None in s for s in seen.values())


def test_broadcast_bound_counts_bytes(spark):
    from pyspark.sql import functions as F
    from routelake.operators.common import broadcastable

    df = spark.range(10).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert broadcastable(df) and not broadcastable(df, max_bytes=5000) and not broadcastable(df, max_rows=9)
    assert broadcastable(df.limit(0))
