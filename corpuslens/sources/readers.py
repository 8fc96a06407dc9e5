"""Scans: labelled posts, named datasets side by side, term lexicons."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import written
from corpuslens.sources.quoted import read_quoted

# Cells of a CSV file that mean "missing".
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Label spellings that stand for the neutral and the positive class.
NEUTRAL_LABELS = ("0", "0.0", "false", "neutral")
POSITIVE_LABELS = ("1", "1.0", "true")


def binary_label(
    label: Column,
    neutral: Collection[str] = NEUTRAL_LABELS,
    positive: Collection[str] = POSITIVE_LABELS,
) -> Column:
    """0 or 1 for the spellings of the two classes, null for any other."""
    text = F.lower(F.trim(label.cast("string")))
    classes = (neutral, 0), (positive, 1)
    column = F.lit(None).cast("int")
    for spellings, value in classes:
        known = [str(s).strip().lower() for s in spellings]
        column = F.when(text.isin(*known), value).otherwise(column)
    return column


def require_columns(df: DataFrame, *names: str) -> None:
    absent = [name for name in sorted(names) if name not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}; there are {', '.join(df.columns)}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute rows only where the files give fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def _scan(spark: SparkSession, path: str, multi_line: bool | str) -> tuple[DataFrame, bool]:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path), False
    if suffix not in ("csv", "tsv"):
        raise ValueError(f"cannot read {path}: no scan for {suffix!r}, only for csv, tsv and parquet")
    sep = "\t" if suffix == "tsv" else ","
    if multi_line == "split":
        return read_quoted(spark, path, sep), True
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"')
    return reader.csv(path, sep=sep), True


def posts_from(
    raw: DataFrame,
    text_column: str = "text",
    label_column: str = "label",
    id_column: str | None = None,
    dataset: str | None = None,
    neutral: Collection[str] = NEUTRAL_LABELS,
    positive: Collection[str] = POSITIVE_LABELS,
    missing_text: Collection[str] = (),
) -> DataFrame:
    """Labelled posts as ``dataset, id, text, label``; every other column is pruned.

    ``neutral`` and ``positive`` are the label spellings of the two classes, in any case.
    A missing label stays null; any other spelling is refused, with its count. Without an
    ``id_column`` ids are drawn once and the rows are written to the shared folder, so
    that later reads see the same ids.
    """
    require_columns(raw, text_column, label_column, *([id_column] if id_column else []))
    label = F.col(label_column).cast("string")
    mapped = binary_label(label, neutral, positive)
    blank = label.isNull() | F.trim(label).isin(*MISSING_CELLS)
    unknown = raw.filter(mapped.isNull() & ~blank).groupBy(label.alias("label")).count()
    found = unknown.orderBy(F.desc("count"), "label").limit(10).collect()
    if found:
        names = ", ".join(f"{r['label']!r} ({r['count']} rows)" for r in found)
        raise ValueError(f"labels in {label_column!r} that are neither neutral nor positive: {names}")
    text = F.col(text_column).cast("string")
    if missing_text:
        text = F.when(text.isin(*missing_text), None).otherwise(text)
    rows = raw.select(
        F.lit(dataset).cast("string").alias("dataset"),
        (F.col(id_column) if id_column else F.monotonically_increasing_id())
        .cast("bigint")
        .alias("id"),
        F.coalesce(text, F.lit("")).alias("text"),
        mapped.alias("label"),
    )
    return rows if id_column else written(rows, "posts")


def load_dataset(
    spark: SparkSession,
    path: str,
    text_column: str = "text",
    label_column: str = "label",
    multi_line: bool | str = True,
    **options,
) -> DataFrame:
    """Labelled posts of a file, see :func:`posts_from` for the options.

    ``multi_line`` keeps quoted newlines, at the price of one task per file; switch it off
    where texts hold none. ``"split"`` keeps them and reads each file by many tasks; the file
    must be well formed, see :func:`corpuslens.sources.quoted.read_quoted`.
    """
    raw, is_csv = _scan(spark, path, multi_line)
    missing = MISSING_CELLS if is_csv else ()
    return posts_from(raw, text_column, label_column, missing_text=missing, **options)


def load_datasets(spark: SparkSession, paths: Mapping[str, str], **options) -> DataFrame:
    """Several named datasets in one table, told apart by ``dataset``."""
    frames = [load_dataset(spark, path, dataset=name, **options) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, frames)


def union_named(frames: list[DataFrame]) -> DataFrame:
    """Row-union by column name; a column absent from a frame is filled with 0."""
    def join(above: DataFrame, below: DataFrame) -> DataFrame:
        return above.unionByName(below, allowMissingColumns=True)

    return reduce(join, frames).fillna(0)


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One lower-case term per line; blank lines are dropped."""
    term = F.lower(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")))
    return spark.read.text(path).select(term.alias("term")).filter(F.col("term") != "")


def dataset_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset").agg(
        F.count("*").alias("n_rows"),
        F.sum("label").alias("n_positive"),
        F.count_if(F.col("label").isNull()).alias("n_unlabelled"),
        F.avg("label").alias("positive_ratio"),
    )
