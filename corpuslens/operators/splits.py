"""Stratified folds and holdouts, class guard, balanced class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import sized

# Each class is cut into 16 ** SHARE_DIGITS shares of similar size.
SHARE_DIGITS = 3


def draw(seed: int, id_col: str = "id") -> Column:
    """A fixed pseudo-random string per row; sorting by it shuffles the rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def rank_in_class(
    df: DataFrame, keys: list[str], seed: int, id_col: str = "id", digits: int = SHARE_DIGITS
) -> DataFrame:
    """Add ``class_rank`` (1..) in drawn order within ``keys``, and ``class_size``.

    One class may hold most of the rows, so no task sorts a whole class. The first hex
    digits of the draw cut each class into equal shares; a row's rank is its rank within
    its share plus the sizes of the shares before. The share table is bounded by the
    number of classes.
    """
    drawn = df.withColumn("_draw", draw(seed, id_col)).withColumn(
        "_share", F.substring("_draw", 1, digits)
    )
    shares = drawn.groupBy(*keys, "_share").agg(F.count("*").alias("_rows"))
    per_class = Window.partitionBy(*keys)
    before = per_class.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized(
        shares.select(
            *keys,
            "_share",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_rows").over(per_class).alias("class_size"),
        )
    )
    within = Window.partitionBy(*keys, "_share").orderBy("_draw")
    return (
        drawn.withColumn("_rank", F.row_number().over(within))
        .join(offsets, [*keys, "_share"])
        .withColumn("class_rank", F.col("_rank") + F.col("_before"))
        .drop("_draw", "_share", "_rank", "_before")
    )


def stratified_folds(
    df: DataFrame,
    k: int = 5,
    seed: int = 42,
    keys: tuple[str, ...] = ("dataset", "label"),
    id_col: str = "id",
    mode: str = "exact",
    digits: int = SHARE_DIGITS,
) -> DataFrame:
    """Add ``fold`` in 1..k.

    ``exact``: class sizes per fold differ by at most one. ``hash``: no shuffle at all,
    even only in expectation. More ``digits`` make the shares that tasks sort smaller.
    """
    if mode == "hash":
        slot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(k))
        return df.withColumn("fold", (slot + 1).cast("int"))
    if mode != "exact":
        raise ValueError(f"unknown fold mode {mode!r}")
    return (
        rank_in_class(df, list(keys), seed, id_col, digits)
        .withColumn("fold", ((F.col("class_rank") - 1) % k + 1).cast("int"))
        .drop("class_rank", "class_size")
    )


def stratified_holdout(
    df: DataFrame,
    test_share: float = 0.2,
    seed: int = 42,
    keys: tuple[str, ...] = ("dataset", "label"),
    id_col: str = "id",
    digits: int = SHARE_DIGITS,
) -> DataFrame:
    """Add ``is_test``: the first ``round(share * size)`` drawn rows of each class."""
    return (
        rank_in_class(df, list(keys), seed, id_col, digits)
        .withColumn(
            "is_test",
            (F.col("class_rank") <= F.round(F.lit(test_share) * F.col("class_size"))).cast("int"),
        )
        .drop("class_rank", "class_size")
    )


def class_guard(df: DataFrame, group: str = "dataset", label: str = "label") -> DataFrame:
    """Keep the groups in which at least two label classes occur."""
    mixed = df.groupBy(group).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return df.join(sized(mixed.filter("low < high").select(group)), group, "left_semi")


def class_weights(df: DataFrame, group: str = "dataset", label: str = "label") -> DataFrame:
    """``(group, label, class_rows, weight)`` with weight n / (classes * class_rows)."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("class_rows"))
    whole = Window.partitionBy(group)
    return counts.withColumn(
        "weight",
        F.sum("class_rows").over(whole)
        / (F.count("*").over(whole) * F.col("class_rows")).cast("double"),
    )


def with_class_weights(df: DataFrame, group: str = "dataset", label: str = "label") -> DataFrame:
    weights = sized(class_weights(df, group, label).drop("class_rows"))
    return df.join(weights, [group, label])
