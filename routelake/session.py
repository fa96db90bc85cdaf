"""SparkSession helpers.

Cluster settings (master, memory, checkpoint dir) come from the launcher;
``get_spark`` only fills in what is unset, so the same code runs in tests on
``local[*]`` and on a cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "routelake", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session; only sets keys the launcher left unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared (HDFS/S3/...) folder and we
    use it as is.  Only when it is unset on a local master (tests) do we create one;
    on a cluster an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="routelake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df, name: str, path: str | None = None):
    """``df`` written once as Parquet into the shared checkpoint folder and read back: readers scan only the columns and rows they
    need, nothing before it runs again, and what an executor computed survives its loss. ``path``: where (default: a new folder)."""
    import uuid

    path = path or scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes a written intermediate table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that have ended. It does so when the driver's JVM collects their plans, which it may not do for
    long while it has memory; steps that shuffle much one after another would hold all of it on disk until then."""
    import gc

    gc.collect()  # what Python still holds of the JVM
    spark._jvm.System.gc()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``routelake`` importable in Python workers (``addPyFile`` of a zip
    of the package), once per application.  Needed by the ``mapInPandas`` /
    ``applyInPandas`` steps, whose functions live in this package.

    On a cluster, submit the package with ``--py-files`` and set
    ``spark.routelake.shipPackage=false`` to skip this."""
    import shutil

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED or spark.conf.get("spark.routelake.shipPackage", "true").lower() == "false":
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="routelake-pkg-"), "routelake")
    archive = shutil.make_archive(out, "zip", root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    _SHIPPED.add(app)

