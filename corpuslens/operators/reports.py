"""Report tables: summaries, ablation differences, pivots, transfer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Experiment names; the full set and the one left out per group.
FULL = "A_FULL"
LEFT_OUT = {
    "TF-IDF": "G_NO_TFIDF",
    "Lexical": "H_NO_LEXICAL",
    "Hate Lexicon": "I_NO_HATE_LEXICON",
    "Sentiment": "J_NO_SENTIMENT",
    "Embedding": "K_NO_EMBEDDING",
}


def mean_std(name: str) -> Column:
    return F.format_string("%.4f ± %.4f", F.col(f"{name}_mean"), F.col(f"{name}_std"))


def cv_summary(summary: DataFrame, key: str = "dataset") -> DataFrame:
    """One row per dataset with ``mean ± std`` strings of four decimals."""
    return summary.select(
        F.initcap(key).alias("Dataset"),
        mean_std("f1").alias("F1 (mean ± std)"),
        mean_std("accuracy").alias("Accuracy (mean ± std)"),
        mean_std("precision").alias("Precision (mean ± std)"),
        mean_std("recall").alias("Recall (mean ± std)"),
    )


def delta_f1(results: DataFrame) -> DataFrame:
    """``(dataset, feature_group, delta_f1)``: F1 of all groups minus F1 without one."""
    names = F.create_map(*[F.lit(x) for pair in LEFT_OUT.items() for x in pair[::-1]])
    full = results.filter(F.col("experiment") == FULL).select(
        "dataset", F.col("f1").alias("full_f1")
    )
    without = results.filter(F.col("experiment").isin(*LEFT_OUT.values())).select(
        "dataset", names[F.col("experiment")].alias("feature_group"), "f1"
    )
    # Without a full experiment the difference is null.
    return without.join(full, "dataset", "left").select(
        "dataset", "feature_group", (F.col("full_f1") - F.col("f1")).alias("delta_f1")
    )


def f1_pivot(results: DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """Experiment by dataset; naming the datasets saves the pass that finds them."""
    return results.groupBy("experiment").pivot("dataset", datasets).agg(F.first("f1"))


def group_ranking(deltas: DataFrame) -> DataFrame:
    order = Window.partitionBy("dataset").orderBy(F.desc("delta_f1"), F.asc("feature_group"))
    return deltas.withColumn("rank", F.row_number().over(order))


def dense_grid(results: DataFrame) -> DataFrame:
    """Every experiment of any dataset for every dataset; a missing F1 is 0."""
    names = results.agg(F.array_sort(F.collect_set("experiment")).alias("names")).scalar()
    grid = results.select("dataset").distinct().select(
        "dataset", F.explode(names).alias("experiment")
    )
    return grid.join(results.select("dataset", "experiment", "f1"), ["dataset", "experiment"], "left").select(
        "dataset",
        "experiment",
        F.replace("experiment", F.lit("_"), F.lit(" ")).alias("experiment_clean"),
        F.coalesce("f1", F.lit(0.0)).alias("f1"),
    )


def f1_drop(transfer: DataFrame) -> DataFrame:
    """Add ``f1_drop_pct``: loss of F1 in percent of the train dataset's own F1, null without one."""
    own = transfer.filter(F.col("train_dataset") == F.col("test_dataset")).select(
        "train_dataset", F.col("f1").alias("own_f1")
    )
    drop = 100 * (F.col("own_f1") - F.col("f1"))
    return (
        transfer.join(own, "train_dataset", "left")
        .withColumn("f1_drop_pct", F.try_divide(drop, F.col("own_f1")))
        .drop("own_f1")
    )


def cross_pivot(drops: DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """Train by test table of F1 and F1 drop."""
    return (
        drops.groupBy("train_dataset")
        .pivot("test_dataset", datasets)
        .agg(F.first("f1").alias("f1"), F.first("f1_drop_pct").alias("f1_drop_pct"))
    )


def nested_transfer(summary: DataFrame) -> DataFrame:
    """One row per train dataset with a map from test dataset to its metrics."""
    metrics = [c for c in summary.columns if c not in ("train_dataset", "test_dataset", "regime")]
    return summary.groupBy("train_dataset").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("test_dataset", F.struct(*metrics))))
        ).alias("by_test_dataset")
    )
