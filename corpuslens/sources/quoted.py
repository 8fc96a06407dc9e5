"""CSV files with quoted newlines, each read by many tasks.

A line end lies inside a quoted cell if the quotes before it are odd in number. The quotes of each byte range of a file are
counted first; their running sum over the ranges, one number per range, tells which ranges begin inside a cell. Then each
task cuts its own ranges into records. What a range begins or ends in the middle of, at most two pieces, is put together
afterwards, record by record. Texts are not shuffled, except for these pieces.

Files must be well formed: a quote only opens or closes a cell or is doubled inside one. A file with an odd number of
quotes is refused. Blank lines between records are skipped, files without a record give no rows, and compressed files are
one range each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.session import SMALL_TABLE_ROWS, small_table, written

WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = "file string, start long, kind int, header boolean, text string"


def read_quoted(spark: SparkSession, path: str, sep: str = ",", max_listed: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Rows of one file or a folder of files with a header line each, all columns as strings.

    Up to ``max_listed`` ranges that begin inside a cell are listed in a broadcast table. Beyond that, lines are
    shuffled and sorted by range instead.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "sep": sep}
    schema = spark.read.options(**options).csv(path).schema
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).alias("odd"),
        F.col("value").alias("text"),
    )
    pieces = _in_order(lines, _opened(lines), max_listed).mapInArrow(_cut, PIECES)
    records = pieces.filter(F.col("kind") == WHOLE).select("header", "text").unionByName(_joined(pieces))
    columns = ", ".join("`{}` string".format(field.name.replace("`", "``")) for field in schema)
    record = F.regexp_replace("text", "\\r\\z", "")
    row = F.from_csv(record, columns, {"multiLine": "true", "quote": '"', "escape": '"', "sep": sep})
    return records.filter(~F.col("header")).select(row.alias("row")).select("row.*")


def _opened(lines: DataFrame) -> DataFrame:
    """``file, start`` of the ranges that begin inside a cell."""
    odd = lines.groupBy("file", "start").agg((F.count_if("odd") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start")
    ranges = written(
        odd.select(
            "file",
            "start",
            (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"),
            (F.sum("odd").over(upto) % 2 == 1).alias("left_open"),
        ),
        "quote-ranges",
    )
    last = ranges.groupBy("file").agg(F.max_by("left_open", "start").alias("left_open"))
    broken = last.filter("left_open").select("file").limit(3).collect()
    if broken:
        names = ", ".join(row["file"] for row in broken)
        raise ValueError(f"an odd number of quotes in {names}")
    return ranges.filter("inside").select("file", "start", F.lit(True).alias("inside"))


def _in_order(lines: DataFrame, opened: DataFrame, max_listed: int) -> DataFrame:
    listed = small_table(opened, max_listed)
    if listed is not None:
        opened = F.broadcast(lines.sparkSession.createDataFrame(listed, opened.schema))
    rows = lines.join(opened, ["file", "start"], "left")
    if listed is None:
        rows = rows.repartition("file", "start").sortWithinPartitions("file", "start", "at")
    return rows.select("file", "start", F.coalesce("inside", F.lit(False)).alias("inside"), "odd", "text")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of ranges whose lines come in order, and the pieces at their ends."""
    here, inside, kind, header, held = None, False, WHOLE, False, []
    for batch in batches:
        found = []
        for file, start, opened, odd, text in zip(*(column.to_pylist() for column in batch.columns)):
            if here != (file, start):
                if held:
                    found.append((*here, kind if kind == HEAD else TAIL, header, "\n".join(held)))
                here, inside, held = (file, start), opened, []
                kind, header = HEAD if opened else WHOLE, start == 0
            if not inside and not odd and text in ("", "\r"):
                continue
            held.append(text)
            inside ^= odd
            if not inside:
                found.append((*here, kind, header, "\n".join(held)))
                kind, header, held = WHOLE, False, []
        yield _batch(found)
    if held:
        yield _batch([(*here, kind if kind == HEAD else TAIL, header, "\n".join(held))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"file": pa.string(), "start": pa.int64(), "kind": pa.int32(), "header": pa.bool_(), "text": pa.string()}
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that lie in several ranges: a tail, and the heads up to the next tail."""
    ends = pieces.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.max(F.when(F.col("kind") == TAIL, F.col("start"))).over(order)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda piece: piece["text"])
    rows = ends.withColumn("begin", begin).groupBy("file", "begin")
    return rows.agg(F.bool_or("header").alias("header"), F.array_join(parts, "\n").alias("text")).select("header", "text")
