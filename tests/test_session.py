from threading import Barrier

import pytest
from pyspark.sql import functions as F

from corpuslens import session as ss


def test_sized_paths_agree(spark):
    df = spark.range(50).select("id", F.array(F.col("id").cast("double")).alias("v"), F.lit(None).cast("string").alias("s"))
    small, large = ss.sized(df), ss.sized(df, max_rows=10)
    assert small.dtypes == large.dtypes == df.dtypes
    assert sorted(small.collect()) == sorted(large.collect()) == sorted(df.collect())
    assert "LocalTableScan" in small._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in large._jdf.queryExecution().executedPlan().toString()


def test_small_side_is_broadcast_by_its_known_size(spark):
    side = ss.sized(spark.range(10).withColumn("x", F.col("id") * 2))
    plan = spark.range(1000).join(side, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_written_partitions_prune(spark):
    df = ss.written(spark.range(10).withColumn("fold", (F.col("id") % 2).cast("int")), "t", "fold")
    plan = df.filter("fold = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan
    assert df.filter("fold = 1").count() == 5


def test_work_dir_is_the_session_setting(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        pytest.skip("the session names no folder")
    assert named.rstrip("/") in ss.work_dir(spark)


def test_threads_do_not_share_properties(spark):
    """Spark sets and clears the number of the running query in its thread's properties."""
    from corpuslens.session import in_threads

    sc, together = spark.sparkContext, Barrier(2)

    def task(name):
        together.wait()
        sc.setLocalProperty("corpuslens.name", name)
        together.wait()
        return sc.getLocalProperty("corpuslens.name")

    assert in_threads(spark, task, ["a", "b"], 2) == ["a", "b"]
