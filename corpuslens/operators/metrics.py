"""Binary-classification metrics over a long table of scored rows.

A scored row holds ``label`` (0/1), ``prediction`` (0/1) and ``score``; key columns such
as regime, train dataset, test dataset and fold say which evaluation it belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import ratio
from corpuslens.session import SMALL_TABLE_ROWS, sized, written

# Metrics that are averaged over folds.
FOLD_METRICS = ("f1", "accuracy", "precision", "recall", "roc_auc")
COUNTS = ("true_positives", "true_negatives", "false_positives", "false_negatives")


def confusion(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Four counts per key, also where truth or prediction has a single class."""
    truth, guess = F.col("label"), F.col("prediction")
    return scored.groupBy(*keys).agg(
        F.count_if((truth == 1) & (guess == 1)).alias("true_positives"),
        F.count_if((truth == 0) & (guess == 0)).alias("true_negatives"),
        F.count_if((truth == 0) & (guess == 1)).alias("false_positives"),
        F.count_if((truth == 1) & (guess == 0)).alias("false_negatives"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the four counts; 0 on empty denominators."""
    tp, tn, fp, fn = (
        F.col(c) for c in COUNTS
    )
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def _auc(negatives_below: Column, keys: list[str], per_score: DataFrame, one_class) -> DataFrame:
    """Rank-sum AUC; ``negatives_below`` counts the negatives with a lower score."""
    wins = F.col("pos") * (negatives_below + F.col("neg") / 2.0)
    totals = per_score.select(*keys, "pos", "neg", wins.alias("wins")).groupBy(*keys).agg(
        F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    pairs = F.col("pos").cast("double") * F.col("neg")
    auc = F.when(pairs > 0, F.try_divide("wins", pairs)).otherwise(F.lit(one_class))
    return totals.select(*keys, auc.cast("double").alias("roc_auc"))


def roc_auc(
    scored: DataFrame,
    keys: list[str],
    one_class: float | None = 0.0,
    small: int = SMALL_TABLE_ROWS,
) -> DataFrame:
    """Exact area under the ROC curve per key, ties counted half.

    Rows are first combined per distinct score. If many scores remain, they are cut into
    ranges of similar size over all keys, negatives are accumulated within each range,
    and the sums of the ranges before are added: no task sees a whole key. The ranges are
    written down before use, because drawing them again could place them differently.
    """
    label = F.col("label").cast("bigint")
    per_score = scored.groupBy(*keys, "score").agg(
        F.sum(label).alias("pos"), F.sum(1 - label).alias("neg")
    )
    return _ranked_auc(per_score, keys, one_class, small)


def _ranked_auc(
    per_score: DataFrame, keys: list[str], one_class: float | None, small: int
) -> DataFrame:
    rows = written(per_score, "scores")
    ascending = Window.partitionBy(*keys).orderBy("score")
    if rows.count() <= small:
        below = F.sum("neg").over(ascending) - F.col("neg")
        return _auc(F.col("below"), keys, rows.withColumn("below", below), one_class)

    ranges = written(
        rows.repartitionByRange(*keys, "score").withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sized(
        ranges.groupBy(*keys, "_range")
        .agg(F.sum("neg").alias("_neg"))
        .select(
            *keys, "_range", F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_before")
        )
    )
    within = Window.partitionBy(*keys, "_range").orderBy("score")
    placed = ranges.join(offsets, [*keys, "_range"]).withColumn(
        "below", F.col("_before") + F.sum("neg").over(within) - F.col("neg")
    )
    return _auc(F.col("below"), keys, placed, one_class)


def evaluate(scored: DataFrame, keys: list[str], one_class: float | None = 0.0) -> DataFrame:
    """Counts and all metrics per key, from a single pass over the scored rows."""
    label = F.col("label").cast("bigint")
    combined = written(
        scored.groupBy(*keys, "score", "prediction").agg(
            F.sum(label).alias("pos"), F.sum(1 - label).alias("neg")
        ),
        "evaluated",
    )

    def total(name: str, prediction: int) -> Column:
        hits = F.when(F.col("prediction") == prediction, F.col(name)).otherwise(0)
        return F.sum(hits)

    counts = combined.groupBy(*keys).agg(
        total("pos", 1).alias("true_positives"),
        total("neg", 0).alias("true_negatives"),
        total("neg", 1).alias("false_positives"),
        total("pos", 0).alias("false_negatives"),
    )
    per_score = combined.groupBy(*keys, "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    auc = _ranked_auc(per_score, keys, one_class, SMALL_TABLE_ROWS)
    if not keys:
        return with_metrics(counts).withColumn("roc_auc", auc.scalar())
    return with_metrics(counts).join(sized(auc), keys)


def classification_report(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per-class, macro and weighted precision, recall, F1 and support, and accuracy."""
    counts = confusion(scored, keys)
    tp, tn, fp, fn = (
        F.col(c) for c in COUNTS
    )

    def side(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = counts.select(
        *keys,
        (tp + tn).alias("correct"),
        F.explode(F.array(side("0", tn, fn, fp), side("1", tp, fp, fn))).alias("c"),
    ).select(*keys, "correct", "c.*")

    def mean(name: str) -> Column:
        return F.avg(name).alias(f"m_{name}")

    def weighted(name: str) -> Column:
        return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(f"w_{name}")

    averages = classes.groupBy(*keys).agg(
        *[mean(c) for c in ("precision", "recall", "f1")],
        *[weighted(c) for c in ("precision", "recall", "f1")],
        ratio(F.max("correct"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )

    def line(name: str, precision: str, recall: str, f1: str) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            F.col(precision).alias("precision"),
            F.col(recall).alias("recall"),
            F.col(f1).alias("f1"),
            F.col("support").alias("support"),
        )

    summary = averages.select(
        *keys,
        F.explode(
            F.array(
                line("macro avg", "m_precision", "m_recall", "m_f1"),
                line("weighted avg", "w_precision", "w_recall", "w_f1"),
                line("accuracy", "accuracy", "accuracy", "accuracy"),
            )
        ).alias("c"),
    ).select(*keys, "c.*")
    return classes.drop("correct").unionByName(summary)


def fold_summary(
    fold_metrics: DataFrame,
    keys: list[str],
    with_rows: bool = False,
    more: Sequence[Column] = (),
) -> DataFrame:
    """Mean and population standard deviation over folds, one row per key.

    ``with_rows`` adds the fold rows themselves as an array, for nested sinks; ``more``
    are further aggregates of the fold rows.
    """
    columns = [F.count("*").alias("n_folds"), *more]
    for name in FOLD_METRICS:
        columns += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    if with_rows:
        rest = [c for c in fold_metrics.columns if c not in keys and c != "fold"]
        rows = F.array_sort(F.collect_list(F.struct("fold", *rest)))
        columns.append(rows.alias("fold_metrics"))
    return fold_metrics.groupBy(*keys).agg(*columns)
