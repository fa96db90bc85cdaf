"""Streams whose results are corrected or closed: keyed upserts of re-landed results (X1) and final windows with late rows.

Both commit each micro-batch as one version of a ``RunStore``, so a batch that Spark replays after a failure replaces
itself or is recognised, and a reader never sees half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelake.session import cut_lineage
from routelake.sources.runs import RunStore

COMPACT_EVERY = 16  # micro-batches between compactions


def newest(df: DataFrame, key, order) -> DataFrame:
    """The row of each key that is greatest by ``order`` (then by its other columns, so the choice never depends on the input's
    order): a partial aggregate, no window over a hot key."""
    key, order = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    others = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order, *[c for c in others if c not in order])).alias("__r"))
    return best.select(*key, *[F.col(f"__r.{c}").alias(c) for c in others])


def _stream(spark: SparkSession, source: str, schema, fmt: str, max_files_per_trigger: int | None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    return (r.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else r).load(source)


def upsert_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform, key, order, fmt: str = "json",
                  max_files_per_trigger: int | None = None, compact_every: int = COMPACT_EVERY):
    """X1 with corrections: newly landed files go through ``transform(df)``, and of each ``key`` only the row with the greatest ``order``
    counts, in whatever order and however often results land. A batch writes only its own newest rows (one committed run);
    readers merge the runs by key, and every ``compact_every`` batches the runs so far become one with a row per key.

    Returns the started query (``availableNow``: it ends when all files are processed)."""
    store = RunStore(spark, sink)
    order = [order] if isinstance(order, str) else list(order)

    def write(batch: DataFrame, batch_id: int) -> None:
        store.write_run(newest(transform(batch), key, order), batch_id)
        if (batch_id + 1) % compact_every == 0:
            store.compact(keep_newest=1, transform=lambda rows: newest(rows, key, [*order, "run_id"]))

    stream = _stream(spark, source, schema, fmt, max_files_per_trigger)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark: SparkSession, sink: str, key, order) -> DataFrame | None:
    """The newest row of each key over all committed batches (of equal ``order``, the one that landed last)."""
    rows = RunStore(spark, sink).read()
    order = [order] if isinstance(order, str) else list(order)
    return None if rows is None else newest(rows, key, [*order, "run_id"]).drop("run_id")


OPEN_RUN = -1  # the run that holds the windows still open; it is replaced with every batch
COUNTS = ["processed", "failed"]
_KEY = ["window_start", "window_end", "task_name"]


def final_windows(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, prepare, window: str = "1 day", delay: str = "1 day",
                  fmt: str = "parquet", max_files_per_trigger: int | None = None):
    """X2 with an end: counts per event-time window and task that are written once, when they can't change any more, and late rows
    counted apart. ``prepare(stream)`` yields ts, task_name, failed.

    As with Spark's own watermark, a batch's rows are late if their window ended at least ``delay`` before the newest event of *earlier*
    batches; after the batch, open windows that ended that long before the newest event so far are final. A batch commits its
    final windows, its late rows' counts, the windows still open (a row per window and task: all the state there is) and the
    newest event time in one version; a batch that is replayed after that is skipped. Rows without a timestamp count as late, in
    no window."""
    store = RunStore(spark, sink)

    def write(batch: DataFrame, batch_id: int) -> None:
        notes = store.meta()
        if notes.get("batch", -1) >= batch_id:
            return  # committed before a failure, replayed after it
        rows = prepare(batch).select("ts", "task_name", F.col("failed").cast("boolean").alias("failed"))
        counts = [F.count(F.lit(1)).alias("processed"), F.count_if("failed").alias("failed"), F.max("ts").alias("newest")]
        timed = rows.groupBy(F.window("ts", window).alias("w"), "task_name").agg(*counts)
        timed = timed.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "task_name", *COUNTS, "newest")
        untimed = rows.where("ts is null").groupBy("task_name").agg(*counts)
        untimed = untimed.select(F.lit(None).cast("timestamp").alias("window_start"), F.lit(None).cast("timestamp").alias("window_end"), "task_name", *COUNTS, "newest")
        mine = cut_lineage(timed.unionByName(untimed))
        seen = mine.agg(F.max("newest").cast("string").alias("t")).first()["t"]
        before = notes.get("newest")
        now = max(filter(None, (seen, before)), default=None)  # timestamps as text of one format
        ended = lambda t: F.col("window_end") <= F.lit(t).cast("timestamp") - F.expr(f"interval {delay}") if t else F.lit(False)
        is_late = F.col("window_end").isNull() | ended(before)
        still = store.read([OPEN_RUN])
        on_time = mine.where(~is_late).select(*_KEY, *COUNTS)
        if still is not None:
            on_time = on_time.unionByName(still.select(*_KEY, *COUNTS))
        on_time = cut_lineage(on_time.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in COUNTS]))
        kind = lambda df, name: df.select(F.lit(name).alias("kind"), *_KEY, *COUNTS)
        done = kind(on_time.where(ended(now)), "final").unionByName(kind(mine.where(is_late), "late"))
        store.write_runs({batch_id: done, OPEN_RUN: kind(on_time.where(~ended(now)), "open")}, {"batch": batch_id, "newest": now})
        if (batch_id + 1) % COMPACT_EVERY == 0:
            store.compact(keep_newest=1)

    stream = _stream(spark, source, schema, fmt, max_files_per_trigger)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_windows(spark: SparkSession, sink: str) -> DataFrame | None:
    """kind (final, late, open), window, task and counts; late rows of a window are added up over the batches."""
    rows = RunStore(spark, sink).read()
    return None if rows is None else rows.groupBy("kind", *_KEY).agg(*[F.sum(c).alias(c) for c in COUNTS])
