"""Helpers shared by the operators: input columns, Arrow batches, bounded caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads; null text is empty text."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(column):
    """A-Z to a-z, all other characters as they are."""
    return F.translate(column, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bound the Arrow batches of the session, each of which is held by the JVM, by Arrow and by Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def map_texts(
    df: DataFrame, rows_of: Callable[[], Callable[[list, list], Iterable[dict[str, list]]]], schema: str
) -> DataFrame:
    """Run a function over ``(doc_id, text)`` in Arrow batches.

    ``rows_of`` is called once per task and returns the function that turns two lists into columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = rows_of()
        for batch in batches:
            for part in pieces(batch):
                yield from work(part.column(0).to_pylist(), part.column(1).to_pylist())

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that only a few whole texts are Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


class Memo(dict):
    """``memo[key]`` computes and remembers; forgets everything at ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int = 200_000):
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value
