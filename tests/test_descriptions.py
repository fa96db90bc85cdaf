"""The gram index of descriptions against a plain search, and the plans that no longer loop over pairs."""

import random

import pytest
from pyspark.sql import functions as F

from routelake.operators import thought as TH
from tests.test_plans import Q, plan


def test_containing_equals_a_plain_search(spark):
    r = random.Random(4)
    alphabet = "abcé İß "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 25))) for _ in range(150)] + ["Group en texts", "GROUP", "a", "ab", ""]
    words = ["a", "é", "ab", "abc", "group", "cab", "zzz", "aba", "bcé", "texts", "", "ß"] + ["".join(r.choice("abc") for _ in range(4)) for _ in range(20)]
    got = TH.containing(spark.createDataFrame([(w,) for w in words], "w2 string"), spark.createDataFrame([(t,) for t in texts + texts[:9]], "txt string"), "w2", "txt")
    lower = {t: spark.createDataFrame([(t,)], "t string").selectExpr("lower(t)").first()[0] for t in set(texts) if "İ" in t}
    want = {(w, t) for w in words if w for t in texts if w in lower.get(t, t.lower())}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_description_map_falls_back_on_the_first_word(spark):
    q = spark.createDataFrame([("Math word problems",), ("Code",), (" code  golf",), ("Nothing here",), (None,), ("",)], "task_description string")
    t = spark.createDataFrame([("Math word problems",), ("harder MATH",), ("Code review",), ("decode it",), (None,)], "task_description string")
    got = {tuple(x) for x in TH.description_map(q, t).collect()}
    assert got == {("Math word problems", "Math word problems"), ("Code", "Code review"), ("Code", "decode it"), (" code  golf", "Code review"), (" code  golf", "decode it")}


@pytest.mark.parametrize("name", ["j4_same_description_templates", "j5_description_map", "j6_top3_similar_templates", "e15_thought_prompts"])
def test_no_nested_loops(spark, sf_dir, name):
    p = plan(Q[name](spark, sf_dir))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_templates_are_counted_before_they_meet_queries(spark):
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "query_id long, task_description string")
    t = spark.createDataFrame([(i, "a") for i in range(50)] + [(99, None)], "template_id long, task_description string")
    out = TH.templates_per_query(q, t)
    assert {tuple(x) for x in out.collect()} == {(1, 50), (2, 50), (3, 0), (4, 0)}
    p = plan(out)
    assert p.index("HashAggregate") and "SortMergeJoin" not in p


def _text_exchanges(df, column):
    """Shuffles of a plan that carry the column, before adaptive execution."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.initialPlan())
        below = node.children()
        here = kind == "ShuffleExchangeExec" and any(column in a for a in node.output().mkString("|").split("|"))
        return here + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_texts_are_not_shuffled_to_their_vectors(spark, sf_dir):
    """A document's text is shuffled to the winners, or as a query to its prompt: never to its vector, and never as a second copy."""
    df = Q["e15_thought_prompts"](spark, sf_dir)
    assert _text_exchanges(df, "thought_template") == 0
    assert _text_exchanges(df, "text#") + _text_exchanges(df, "query#") == 2
    assert "thought-corpus" not in plan(df)


def test_prompts_from_texts_apart_from_the_vectors(spark):
    """Several descriptions lead to one template; ids repeat; a text made after the search equals one that stood in the templates."""
    q = spark.createDataFrame([(1, "q one", "a", [1.0, 0.0]), (2, "q two", "group x", [0.0, 1.0]), (2, "q two again", "group x", [1.0, 1.0]), (3, None, "a", [1.0, 2.0]), (4, "no", "zzz", [1.0, 0.0]),
                               (5, "no vector", "a", None)], "query_id long, query string, task_description string, embedding array<double>")
    rows = [(i, f"t{i}" if i % 5 else None, ["a", "group y", "my GROUP"][i % 3], [float(i % 4), 1.0]) for i in range(12)]
    rows += [(3, "t3 again", "a", [3.0, 1.0]), (4, "t4 elsewhere", "a", [0.5, 0.5]), (None, "no id", "a", [1.0, 0.0])]
    t = spark.createDataFrame(rows, "template_id long, query string, task_description string, embedding array<double>")
    whole = TH.thought_prompts(q, t.withColumn("thought_template", F.concat(F.lit("T: "), "query")))
    apart = TH.thought_prompts(q.drop("embedding"), t.drop("embedding"), searched=(q.drop("query"), t.drop("query")), carried=(),
                               thought=lambda e: F.concat(F.lit("T: "), e["query"]))
    cols = ["query_id", "query", "similar_queries", "thought_prompt_all"]
    show = lambda df: sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert show(whole) == show(apart)
    got = {(r[0], r[1]): r[3] for r in show(apart)}
    assert len(got) == 6 and got[(4, "no")] is None and got[(5, "no vector")] is None
    assert got[(1, "q one")].startswith(TH.FEWSHOT_HEAD) and "t3 again\n\nThought Template 2: T: t3 again" in got[(1, "q one")]
    assert any(r[2] for r in show(apart) if r[0] == 2)
