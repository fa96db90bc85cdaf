"""The pipeline's stages, one by one on planted documents, and the whole over odd rows."""

import corpus_pipeline
from routelake.session import scratch_path

WORDS = "river stone window garden paper yellow summer travel kitchen market silver doctor bridge forest planet candle".split()


def text(seed: int, n: int = 40) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i * seed) % 16] + str((seed * 31 + i) % 97) * (i % 3 == 0) for i in range(n))


ITEM = " ".join(f"item word{i}" for i in range(12))
DOCS = [(1, text(1), "en"), (2, text(1) + " tail", "en"), (3, text(2), "en"), (4, "intro " + ITEM + " outro", "en"), (5, None, "en"), (6, "", None),
        (7, "123 456", "en"), (8, text(5), None), (None, text(9), "en"), (3, text(2), "en")]


def test_stages(spark):
    sf = scratch_path(spark, f"pipeline-test-{id(spark)}")
    docs = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept.append(sorted(((r.doc_id or 0) for r in out.collect())))
        docs = out
    assert names == ["language_id", "near_dedup", "decontaminate", "byte_bpe"]
    assert kept == [[0, 1, 2, 3, 3, 4, 8], [0, 1, 3, 4, 8], [0, 1, 3, 8]]
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted((r.doc_id or 0) for r in coded) == kept[-1] and all(len(r.ids) == 4 * r.n_tokens for r in coded)
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.run(spark, sf).collect()) == kept[-1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_duplicates_are_decided_by_rows(spark):
    """Repeated and null ids: one row of each group stays, and a unique text stays whatever its id."""
    rows = [(1, text(1), "en"), (1, text(1), "en"), (None, text(1) + " tail", "en"), (7, text(2), "en"), (3, text(2), "de"), (3, text(4), "en"), (None, text(6), "en"),
            (None, text(6), "en"), (9, None, "en"), (9, None, "en"), (10, "", "en")]
    docs = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, text(1), "en"), (3, text(2), "de"), (3, text(4), "en"), (None, text(6), "en"), (9, None, "en"), (9, None, "en"), (10, "", "en")]
    assert sorted(((r.doc_id, r.text, r.lang) for r in out.collect()), key=str) == sorted(want, key=str)


def test_clashing_columns_pass_through(spark):
    extra = ["_text0", "_text", "score", "lang_pred", "predicted_lang", "predicted_lang_score", "row", "component_id", "key", "stays", "item_id", "n_tokens", "ids", "decoded"]
    docs = spark.createDataFrame([(i, text(i), "en", "s", 1, *(f"{c}{i}" for c in extra)) for i in range(3)],
                                 SCHEMA + "".join(f", `{c}` string" for c in extra))
    sf = scratch_path(spark, f"pipeline-clash-{id(docs)}")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
    assert corpus_pipeline.encode(spark, out, sf).count() == 3


def test_empty_tables(spark):
    sf = scratch_path(spark, f"pipeline-empty-{id(spark)}")
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{sf}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, sf).collect() == []
