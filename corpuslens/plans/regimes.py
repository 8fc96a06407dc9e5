"""Four train/test regimes over several datasets, as tables of scored rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.classify import CONVERGENCE, convergence
from corpuslens.operators.many_models import MAX_ITER, LogisticModel, ManyFit, fit_many, score_many
from corpuslens.operators.metrics import COUNTS, FOLD_METRICS, evaluate, fold_summary
from corpuslens.operators.reports import f1_drop
from corpuslens.operators.splits import class_guard, stratified_folds
from corpuslens.plans.features import GROUPS, FeatureExtractor
from corpuslens.session import in_threads, written

REGIMES = ("cv", "cross", "loo", "global")
KEYS = ["regime", "train_dataset", "test_dataset", "fold"]


@dataclass(frozen=True)
class Fit:
    """One model: which rows train it and which rows it is tested on."""

    regime: str
    train_name: str
    train: Column
    test: Column


def plan_fits(datasets: list[str], k: int, regimes: tuple[str, ...] = REGIMES) -> list[Fit]:
    dataset, fold = F.col("dataset"), F.col("fold")
    fits: list[Fit] = []
    if "cv" in regimes:
        for name in datasets:
            for i in range(1, k + 1):
                own = dataset == name
                fits.append(Fit("cv", name, own & (fold != i), own & (fold == i)))
    if len(datasets) > 1:
        if "cross" in regimes:
            fits += [Fit("cross", n, dataset == n, dataset != n) for n in datasets]
        if "loo" in regimes:
            fits += [
                Fit("loo", f"all_except_{n}", dataset != n, dataset == n) for n in datasets
            ]
    if "global" in regimes:
        fits += [Fit("global", "all", fold != i, fold == i) for i in range(1, k + 1)]
    return fits


def run_regimes(
    rows: DataFrame,
    extractor: FeatureExtractor,
    regimes: tuple[str, ...] = REGIMES,
    k: int = 5,
    seed: int = 42,
    fit_scope: str = "train",
    fold_mode: str = "exact",
    max_iter: int = MAX_ITER,
) -> DataFrame:
    """Scored rows of every evaluation: keys, ``id, label, prediction, score``, and of the
    model's fit ``iterations``, ``limit_reached`` and ``gradient_norm``.

    ``fit_scope="train"`` learns features from the training rows of each model alone.
    ``"all"`` learns them once per dataset from all its rows, before the folds are cut; all models
    are then trained in the same passes over one feature table. Rows without a label take no part.
    Either way a model is fitted once and its test rows of all folds are scored in one pass.
    """
    if fit_scope not in ("train", "all"):
        raise ValueError(f"unknown fit_scope {fit_scope!r}")
    folded, fits = folds_and_fits(rows, regimes, k, seed, fold_mode)
    part, wanted = _parts(folded, fits)
    if fit_scope == "all":
        store = extractor.fit(folded).store(folded, "dataset", "fold")
        return written(_scored(store, part, fits, wanted, max_iter), "scored")

    # What does not depend on the training rows is the same for all models.
    fixed = written(extractor.fixed(folded), "fixed", "dataset", "fold")

    def alone(i: int) -> DataFrame:
        pooled, own = (df.withColumn("pool", F.lit("pool")) for df in (folded, fixed))
        used = fits[i].train | fits[i].test
        model = replace(extractor, group_col="pool").fit(pooled.filter(fits[i].train))
        store = model.store(pooled.filter(used), "dataset", "fold", fixed=own.filter(used))
        return _scored(store, part, [fits[i]], [wanted[i]], max_iter)

    frames = in_threads(rows.sparkSession, alone, list(range(len(fits))), extractor.settings.parallel_fits)
    return written(_union(frames), "scored")


def folds_and_fits(
    rows: DataFrame, regimes: tuple[str, ...] = REGIMES, k: int = 5, seed: int = 42, fold_mode: str = "exact"
) -> tuple[DataFrame, list[Fit]]:
    """The labelled rows of datasets with both classes in folds, and the models to train on them."""
    labelled = class_guard(rows.filter(F.col("label").isNotNull()))
    folded = written(stratified_folds(labelled, k, seed, mode=fold_mode), "folds", "dataset", "fold")
    names = folded.select("dataset").distinct().collect()
    fits = plan_fits(sorted(r["dataset"] for r in names), k, regimes)
    if not fits:
        raise ValueError("no dataset with two label classes")
    return folded, fits


def planned_tests(folded: DataFrame, fits: list[Fit]) -> DataFrame:
    """``regime, train_dataset, test_dataset, fold, n_rows, n_positive`` of every test that the fits plan, without training."""
    counts = folded.groupBy("dataset", "fold").agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_positive"))
    tests = [F.when(fit.test, F.struct(F.lit(fit.regime).alias("regime"), F.lit(fit.train_name).alias("train_dataset"))) for fit in fits]
    return counts.select(
        F.explode(F.array_compact(F.array(*tests))).alias("f"), F.col("dataset").alias("test_dataset"), "fold", "n_rows", "n_positive"
    ).select("f.*", "test_dataset", "fold", "n_rows", "n_positive")


def _parts(folded: DataFrame, fits: list[Fit]) -> tuple[Column, list[ManyFit]]:
    """A number per dataset and fold, and each fit by the parts that train it and those it is tested on."""
    cells = folded.select("dataset", "fold").distinct()
    flags = [(fit.train if kind else fit.test).alias(f"{kind}_{i}") for i, fit in enumerate(fits) for kind in (0, 1)]
    # As many rows as datasets times folds.
    found = cells.select("dataset", "fold", *flags).orderBy("dataset", "fold").collect()
    sides = [
        ManyFit(*(frozenset(p for p, row in enumerate(found) if row[f"{kind}_{i}"]) for kind in (1, 0)))
        for i in range(len(fits))
    ]
    return part_of({(row["fold"], row["dataset"]): p for p, row in enumerate(found)}, "fold", "dataset"), sides


def part_of(numbers: dict[tuple, int], *columns: str) -> Column:
    """The number of a row's values of ``columns``; a lookup inside the row."""
    pairs = [F.lit(x) for key, number in numbers.items() for x in ("|".join(map(str, key)), number)]
    return F.create_map(*pairs)[F.concat_ws("|", *columns)]


def _scored(store: DataFrame, part: Column, fits: list[Fit], wanted: list[ManyFit], max_iter: int) -> DataFrame:
    rows = store.withColumn("part", part)
    models = fit_many(rows, wanted, GROUPS, max_iter=max_iter)
    scored = score_many(rows, wanted, models, ["dataset", "fold", "id", "label"])
    kinds = [(i, fit.regime, fit.train_name) for i, fit in enumerate(fits)]
    return with_fits(scored, kinds, "fit int, regime string, train_dataset string", models).select(
        "regime", "train_dataset", F.col("dataset").alias("test_dataset"), "fold", "id", "label", "prediction", "score", *CONVERGENCE
    )


def with_fits(scored: DataFrame, kinds: list[tuple], schema: str, models: list[LogisticModel]) -> DataFrame:
    """Scored rows with what is known of their fit: ``kinds`` (the number first) and how it ended."""
    rows = [(*kind, *convergence(model).values()) for kind, model in zip(kinds, models)]
    known = scored.sparkSession.createDataFrame(rows, f"{schema}, iterations int, limit_reached boolean, gradient_norm double")
    return scored.join(known, "fit").drop("fit")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fold_metrics(scored: DataFrame) -> DataFrame:
    """Counts and metrics per evaluation and fold.

    AUC of a fold with one class is null in the global regime and 0.0 elsewhere.
    """
    fit = [c for c in CONVERGENCE if c in scored.columns]
    rows = evaluate(scored, [*KEYS, *fit], one_class=None)
    auc = F.when(F.col("regime") == "global", F.col("roc_auc")).otherwise(
        F.coalesce("roc_auc", F.lit(0.0))
    )
    return rows.withColumn("roc_auc", auc)


def overall_summary(scored: DataFrame, with_rows: bool = False) -> DataFrame:
    """Mean and deviation over folds for every evaluation of every regime.

    Added are the confusion counts of all folds, the folds with an AUC (those with both
    classes in the global regime), the longest fit, the folds whose fit hit the limit and the
    largest gradient that a fit was left with.
    """
    keys = ["regime", "train_dataset", "test_dataset"]
    folds = fold_metrics(scored)
    pooled = [F.sum(name).alias(name) for name in COUNTS]
    pooled.append(F.count("roc_auc").alias("n_auc_folds"))
    if "iterations" in folds.columns:
        pooled += [
            F.max("iterations").alias("max_iterations"),
            F.count_if("limit_reached").alias("n_limit_reached"),
            F.max("gradient_norm").alias("max_gradient_norm"),
        ]
    return fold_summary(folds, keys, with_rows, pooled)


def transfer_summary(summary: DataFrame) -> DataFrame:
    """Train by test table with F1 drop, from the ``cv`` and ``cross`` rows of a summary.

    A dataset's own row is its cross-validation. Raises if a train dataset has none.
    """
    rows = summary.filter(F.col("regime").isin("cv", "cross")).select(
        "train_dataset",
        "test_dataset",
        *[F.col(f"{name}_mean").alias(name) for name in FOLD_METRICS],
    )
    own = rows.filter(F.col("train_dataset") == F.col("test_dataset")).select("train_dataset")
    # One row per train dataset that lacks its own.
    lacking = rows.join(own, "train_dataset", "left_anti").select("train_dataset").distinct()
    names = sorted(r["train_dataset"] for r in lacking.collect())
    if names:
        raise ValueError(f"no cross-validation row for {', '.join(names)}: run the cv regime too")
    return f1_drop(rows)


def nested_summary(scored: DataFrame) -> DataFrame:
    """One row per regime holding all its evaluations with their folds, for a JSON sink."""
    summary = overall_summary(scored, with_rows=True)
    rest = [c for c in summary.columns if c != "regime"]
    return summary.groupBy("regime").agg(
        F.array_sort(F.collect_list(F.struct(*rest))).alias("evaluations")
    )
