"""Token-count rollups maintained by deltas.

A batch holds signed rows: +1 for an insert, -1 for a delete, and both for a revised count. It is aggregated to
(source, lang, tokenizer) and committed as one folder of the rollup's store; totals are the sums over committed
batches. Spark's commit protocol writes ``_SUCCESS`` last, so a batch counts whole or not at all, and committing a batch
again changes nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelake.llm.common import worker_state

KEYS = ["source", "lang", "tokenizer"]


class Rollup:
    """Additive totals in a folder that all executors share."""

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.store, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch_id: str) -> bool:
        return self._fs().exists(self._path(f"batch-{batch_id}", "_SUCCESS"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds ``changes(sign, source, lang, tokenizer, n_tokens)``; False if the batch was committed before. What an
        interrupted commit left is overwritten."""
        if self.committed(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.store}/batch-{batch_id}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches; combinations without documents are gone."""
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(self._path())] if fs.exists(self._path()) else []
        paths = [f"{self.store}/{n}" for n in sorted(names) if n.startswith("batch-") and self.committed(n.removeprefix("batch-"))]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(1).cast("long").alias("sign"), *KEYS, "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(-1).cast("long").alias("sign"), *KEYS, "n_tokens")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the rows of ``old`` by those of ``new``; equal rows cancel in the sums, so no join is needed."""
    return deletes(old).unionByName(inserts(new))


def count_tokens(docs: DataFrame, path: str, pattern: str, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, text_hash (128 bits), tokenizer and n_tokens of ``docs(doc_id, text, source, lang)`` by a rank file
    for tiktoken. A null text has no tokens; null sources and languages are groups of their own; other columns are ignored."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                      F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.lit(tokenizer).alias("tokenizer"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            return tiktoken.Encoding(tokenizer, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        encode = worker_state(("token_counts", path, pattern), make).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t.as_py())) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return src.mapInArrow(run, "doc_id long, source string, lang string, text_hash string, tokenizer string, n_tokens long")


def maintain(counts: DataFrame, rollup: Rollup) -> DataFrame:
    """The life of a corpus as batches: every document is inserted; exact copies are deleted (the smallest doc_id of each text stays);
    what stays is revised to count an end token; and the first batch arrives once more, which changes nothing.

    Copies are found by aggregates over (text, source, lang), never by collecting a group. Copies with the same smallest doc_id
    (or all without one, which come last) are told apart by source, then language, nulls last; texts of any length count whole; an
    empty table gives no totals."""
    rollup.commit("0-insert", inserts(counts))
    by_text = counts.groupBy("text_hash", *KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.first("n_tokens").alias("n_tokens"))
    order = F.struct(F.col("least").isNull(), "least", F.col("source").isNull(), "source", F.col("lang").isNull(), "lang")
    kept = by_text.groupBy("text_hash").agg(F.min_by(F.struct(*KEYS, "n_tokens"), order).alias("kept")).select("kept.*")
    copies = by_text.select(F.col("n"), *KEYS, "n_tokens")
    gone = copies.select((-F.col("n")).alias("sign"), *KEYS, "n_tokens").unionByName(inserts(kept))
    rollup.commit("1-copies", gone)
    rollup.commit("2-end-token", revisions(kept, kept.withColumn("n_tokens", F.col("n_tokens") + 1)))
    rollup.commit("0-insert", inserts(counts))
    return rollup.totals()
