"""Skew handling: a key holding a third of all rows is split over several
tasks, results equal the plain window; bounded broadcast falls back above its bound."""

import contextlib
import io

from pyspark.sql import Window
from pyspark.sql import functions as F

from routelake.operators import common as C
from routelake.operators import ranking as R


def _skewed(spark, n=30000):
    # key 0 holds a third of the rows, the rest spread over 2,000 keys
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000 + 1).alias("k"),
                                 F.col("id").alias("v"))


def test_number_within_groups_matches_window_and_spreads_hot_key(spark):
    df = _skewed(spark)
    got = R.number_within_groups(df, "k", "v", "rn", partitions=8)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    hot = df.where(F.col("k") == 0).repartitionByRange(8, "k", "v").select(F.spark_partition_id().alias("p"))
    assert hot.distinct().count() > 1  # the hot key is not confined to one task


def test_ratio_split_on_hot_group(spark):
    df = _skewed(spark).withColumn("q", F.col("v"))
    out = R.ratio_split(df, "k", "q", (0.5, 0.25, 0.25)).where(F.col("k") == 0)
    counts = {r["split_role"]: r["count"] for r in out.groupBy("split_role").count().collect()}
    assert counts == {"train": 5000, "validate": 2500, "test": 2500}


def test_broadcast_only_below_bound(spark):
    big, small = _skewed(spark), spark.range(10).withColumnRenamed("id", "k")

    def plan(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        return buf.getvalue()

    assert "BroadcastHashJoin" in plan(C.join_dim(big, small, "k", max_rows=100))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "BroadcastHashJoin" not in plan(C.join_dim(big, small, "k", max_rows=5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_distinct_list_refuses_unbounded(spark):
    import pytest
    with pytest.raises(ValueError):
        R.distinct_sorted_list(_skewed(spark), "v", max_values=100)
