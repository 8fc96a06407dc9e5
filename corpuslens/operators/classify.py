"""Class-weighted logistic regression of one model on a column of vectors."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.many_models import MAX_ITER, TOLERANCE, LogisticModel, ManyFit, fit_many, score_many

# Rows that one task should at least hold while a forest grows.
ROWS_PER_TASK = 10_000


def balanced(
    train: DataFrame, rows_per_task: int = ROWS_PER_TASK, most_tasks: int | None = None, weight: str = "weight"
) -> tuple[DataFrame, int]:
    """Weight n / (2 * class size) per row, and n. Only two counts reach the driver.

    A few rows per task would make scheduling the main cost of a fit that runs many
    jobs, so the number of tasks follows the number of rows, up to ``most_tasks``. Rows are dealt and
    sorted by ``id`` if they have one: then what a seeded fit draws depends on rows and
    seed alone, not on how the input was laid out.
    """
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"training rows need labels 0 and 1, got {list(counts)}")
    n = sum(counts.values())
    per_class = F.when(F.col("label") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    weighted, tasks = train.withColumn(weight, per_class), min(n // rows_per_task + 1, most_tasks or n + 1)
    if "id" in train.columns:
        weighted = weighted.repartition(tasks, "id").sortWithinPartitions("id")
    else:
        weighted = weighted.coalesce(tasks)
    return weighted, n


def fit_logistic(
    train: DataFrame, features: str = "features", max_iter: int = MAX_ITER, tolerance: float = TOLERANCE, leading: int | None = None
) -> LogisticModel:
    """L2-penalised fit with C = 1 and balanced weights, on rows that are cheap to read again.

    ``leading`` columns of the vector that are dense and of any scale keep a fit of wide vectors from taking many passes.
    A fit that ends at the limit is logged; see :func:`convergence`.
    """
    rows = train.select(F.lit(0).alias("part"), "label", features)
    return fit_many(rows, [ManyFit(frozenset([0]))], [features], max_iter=max_iter, tolerance=tolerance, leading=leading)[0]


# How the model of a row was fitted.
CONVERGENCE = ("iterations", "limit_reached", "gradient_norm")


def convergence(model: LogisticModel) -> dict[str, int | bool | float]:
    """Newton steps of a fit, whether the limit ended it, and the gradient that was left."""
    return {name: value for name, value in asdict(model).items() if name in CONVERGENCE}


def score(model: LogisticModel, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` (int) and ``score`` = P(1); the vector column goes."""
    keep = [c for c in rows.columns if c not in model.columns]
    every = ManyFit(frozenset(), frozenset([0]))
    return score_many(rows.withColumn("part", F.lit(0)), [every], [model], keep).drop("fit")
