"""Session helpers: tuned builder, shared work folder, size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

# A table with at most this many rows may travel through the driver (models, class
# counts, dictionaries). Anything larger stays distributed.
SMALL_TABLE_ROWS = 100_000


def build_session(master: str | None = None, app: str = "corpuslens", **conf: str) -> SparkSession:
    """Session with adaptive execution and ANSI arithmetic left at their defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall
    back to a folder of this machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    active = sc.getCheckpointDir()
    if active is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="corpuslens-")
        sc.setCheckpointDir(named)
        active = sc.getCheckpointDir()
    return active


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> pa.Table | None:
    """Contents of ``df`` if it has at most ``max_rows`` rows, else None."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def sized(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Settle a derived side table before it is joined.

    A table within the bound becomes a local relation: Catalyst then knows its exact
    size and broadcasts it by its own threshold. A larger one is written once, so its
    size on disk is known too and a shuffle join is planned.
    """
    table = small_table(df, max_rows)
    if table is None:
        return written(df, "side")
    return df.sparkSession.createDataFrame(table, df.schema)


def in_threads(spark: SparkSession, task: Callable, items: list, workers: int) -> list:
    """Run independent jobs from a few driver threads; the work stays on executors.

    Each call gets its own copy of the thread's properties: Spark writes to them during a query.
    """
    calls = [inheritable_thread_target(spark)(partial(task, item)) for item in items]
    with ThreadPool(workers) as pool:
        return pool.map(lambda call: call(), calls, chunksize=1)
