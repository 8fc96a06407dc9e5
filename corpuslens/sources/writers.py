"""Sinks: JSON results, CSV tables, run-partitioned trees, lexicon files."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


# Fixed value: how a run id shows its time.
RUN_TIME = "%Y%m%d_%H%M%S"
# Written after the rows of a run, so a run without it is not whole.
MANIFESTS = "_manifests"


def new_run_id() -> str:
    """The time, and a suffix that keeps runs of one second apart."""
    return f"{datetime.now().strftime(RUN_TIME)}_{uuid.uuid4().hex[:12]}"


def save_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; nest with ``struct`` and ``collect_list`` beforehand."""
    df.write.mode("overwrite").json(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_run(results: DataFrame, base: str, run_id: str | None = None) -> str:
    """Result rows under ``base/run_id=.../regime=...``; returns the run id.

    The rows are written first and the run's manifest, the list of its files with their number of rows, last: a run that
    fails on the way leaves no manifest and is invisible to :func:`read_runs`. A run id can be used once.
    """
    run_id = run_id or new_run_id()
    spark = results.sparkSession
    folder = f"{base}/run_id={run_id}"
    results.write.mode("errorifexists").partitionBy("regime").parquet(folder)
    rows = spark.read.schema(results.schema).parquet(folder)
    files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"))
    listed = files.select(F.lit(run_id).alias("run_id"), "file", "n_rows")
    listed.coalesce(1).write.mode("errorifexists").parquet(f"{base}/{MANIFESTS}/{run_id}")
    return run_id


def read_runs(spark: SparkSession, base: str, schema: StructType, run_ids: list[str] | None = None) -> DataFrame:
    """Rows of whole runs with their ``run_id``: those whose manifest is there. Files that no manifest names are left out."""
    manifests = spark.read.schema("run_id string, file string, n_rows long").parquet(f"{base}/{MANIFESTS}/*")
    if run_ids is not None:
        manifests = manifests.where(F.col("run_id").isin(run_ids))
    with_id = StructType([*schema.fields, StructField("run_id", StringType())])
    rows = spark.read.schema(with_id).option("basePath", base).parquet(f"{base}/run_id=*")
    # One row per file of a run; only the names are compared.
    return rows.withColumn("_file", F.col("_metadata.file_path")).join(
        manifests.select(F.col("file").alias("_file")), "_file", "left_semi"
    ).drop("_file")


def save_lexicon(terms: DataFrame, path: str) -> None:
    """Distinct lower-case terms, one per line, in order across the part files."""
    (
        terms.select(F.lower("term").alias("term"))
        .distinct()
        .orderBy("term")
        .write.mode("overwrite")
        .text(path)
    )
