"""A corpus pipeline over ``documents``: language ID, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads back as the
next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from routelake.llm import byte_bpe, decontaminate, language, near_dup
from routelake.llm.common import table, written
from routelake.llm.queries import BPE_RANKS, PIECES

SIMILAR_PERCENT = 80  # shared part of two documents' distinct 5-word shingles that makes them near duplicates


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``docs`` has no column of."""
    while name in docs.columns:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rejects documents without a language (no text or no letter in it); ``lang`` becomes the predicted one.

    Rows are judged one by one: null or repeated doc_ids and repeated rows stay as they are, a null lang is no label, texts of any length
    are scored whole, ties go to the alphabetically first language. Without any label every document is rejected; an
    empty table stays empty; all other columns, whatever their names, are passed on."""
    model = language.train(docs.where("lang is not null"), PIECES)
    pred, score = _free(docs, "predicted_lang"), _free(docs, "predicted_lang_score")
    judged = language.classify(docs, model, pred=pred, score=score).where(F.col(pred) != "und")
    return judged.select(*[F.col(pred).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one row of each near-duplicate group stays, the one with the smallest doc_id (a null one only if all are null; the first
    in the input's order on a tie).

    Groups are found and decided by rows, not by doc_id: of repeated rows one stays, rows without doc_id take part, and a row
    whose doc_id a duplicate repeats stays if its own text is no duplicate. Null, empty and wordless texts are no duplicates of anything;
    texts of any length are compared whole; an empty table stays empty; other columns are passed on."""
    row = _free(docs, "row")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")  # fixed once: both branches below see it
    found = near_dup.near_duplicates(keyed.select(F.col(row).alias("doc_id"), F.col("text")), SIMILAR_PERCENT).select(F.col("doc_id").alias("key"), "component_id")
    ids = keyed.select(F.col(row).alias("key"), F.col("doc_id").cast("long").alias("id"))
    members = written(found.join(ids, "key"), "pipeline-members")
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("stays")).select("stays.key")
    gone = members.select("key").join(stays, "key", "left_anti").withColumnRenamed("key", row)  # by row: a large group is no hot key
    return keyed.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go.

    Rows are judged one by one, so null and repeated doc_ids make no difference; null, empty and wordless texts and items match nothing;
    texts of any length are searched whole; without documents or items nothing goes; all columns are passed on."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token ids of what is left, checked by decoding: doc_id, n_tokens, ids, decoded_sha256.

    A row for every row: null and repeated doc_ids stay, a null text has no tokens, texts of any length are encoded whole; an empty
    table gives an empty result; other columns are left out."""
    coded = byte_bpe.encode_documents(docs, BPE_RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: The stages learn models and cluster texts, which SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
