"""Feature-group ablation on a stratified holdout."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.vectors import stored_vectors
from corpuslens.operators.classify import CONVERGENCE
from corpuslens.operators.many_models import MAX_ITER, TOLERANCE, LogisticModel, ManyFit, fit_many, score_many
from corpuslens.operators.metrics import evaluate
from corpuslens.operators.splits import class_guard, stratified_holdout
from corpuslens.plans.features import LEXICAL_GROUP, LEXICON_GROUP, SENTIMENT_GROUP, Dictionaries, FeatureExtractor, row_features
from corpuslens.plans.regimes import part_of, with_fits
from corpuslens.session import written

# Experiments and the feature groups each one uses.
EXPERIMENTS = {
    "A_FULL": ("lexical", "hate_lexicon", "sentiment", "embedding", "tfidf"),
    "B_TFIDF_ONLY": ("tfidf",),
    "C_LEXICAL_ONLY": ("lexical",),
    "D_HATE_LEXICON_ONLY": ("hate_lexicon",),
    "E_SENTIMENT_ONLY": ("sentiment",),
    "F_EMBEDDING_ONLY": ("embedding",),
    "G_NO_TFIDF": ("lexical", "hate_lexicon", "sentiment", "embedding"),
    "H_NO_LEXICAL": ("hate_lexicon", "sentiment", "embedding", "tfidf"),
    "I_NO_HATE_LEXICON": ("lexical", "sentiment", "embedding", "tfidf"),
    "J_NO_SENTIMENT": ("lexical", "hate_lexicon", "embedding", "tfidf"),
    "K_NO_EMBEDDING": ("lexical", "hate_lexicon", "sentiment", "tfidf"),
}


def run_ablation(
    rows: DataFrame,
    extractor: FeatureExtractor,
    test_share: float = 0.2,
    seed: int = 42,
    max_iter: int = MAX_ITER,
) -> DataFrame:
    """``dataset, experiment, n_features``, the fit's iterations and the metrics of each experiment.

    Features are learned from the training rows of each dataset. Experiments whose
    feature groups are all empty are left out.
    """
    split = holdout(rows, test_share, seed)
    model = extractor.fit(split.filter("is_test = 0"))
    store = model.store(split, "dataset", "is_test")
    sizes = {dataset: model.group_sizes(dataset) for dataset in sorted(model.tfidf.sizes())}
    scored, _ = score_experiments(store, sizes, max_iter=max_iter)
    return evaluate(written(scored, "ablation"), ["dataset", "experiment", "n_features", *CONVERGENCE])


def holdout(rows: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """The labelled rows of datasets with both classes, with ``is_test``."""
    labelled = class_guard(rows.filter(F.col("label").isNotNull()))
    return written(stratified_holdout(labelled, test_share, seed), "holdout", "is_test")


def row_store(split: DataFrame, dictionaries: Dictionaries) -> tuple[DataFrame, dict[str, int]]:
    """The groups that need nothing but the row and the dictionaries, one vector each; and their sizes."""
    groups = {"lexical": LEXICAL_GROUP, "hate_lexicon": LEXICON_GROUP, "sentiment": SENTIMENT_GROUP}
    vectors = [array_to_vector(F.array(*[F.col(c).cast("double") for c in names])).alias(g) for g, names in groups.items()]
    keep = [c for c in split.columns if c != "text"]
    store = stored_vectors(row_features(split, dictionaries).select(*keep, *vectors), list(groups), "features", "dataset", "is_test")
    return store, {group: len(names) for group, names in groups.items()}


def score_experiments(
    store: DataFrame,
    sizes: dict[str, dict[str, int]],
    experiments: dict[str, tuple[str, ...]] = EXPERIMENTS,
    max_iter: int = MAX_ITER,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, list[tuple[str, str, LogisticModel]]]:
    """Test rows under the models of every dataset and experiment, and these models.

    ``sizes`` has the number of columns per dataset and group. All models are trained in the same
    scans of ``store``; an experiment sees the columns of its groups.
    """
    # Even parts train, odd ones test.
    part = {dataset: 2 * i for i, dataset in enumerate(sizes)}
    groups = tuple(next(iter(sizes.values())))
    kinds, fits = [], []
    for dataset, own in sizes.items():
        for experiment, wanted in experiments.items():
            n_features = sum(own[g] for g in wanted)
            if n_features:
                kinds.append((len(fits), dataset, experiment, n_features))
                fits.append(ManyFit(frozenset([part[dataset]]), frozenset([part[dataset] + 1]), wanted))
    numbers = {(test, dataset): p + test for dataset, p in part.items() for test in (0, 1)}
    vectors = store.withColumn("part", part_of(numbers, "is_test", "dataset"))
    models = fit_many(vectors, fits, groups, max_iter=max_iter, tolerance=tolerance)
    scored = score_many(vectors, fits, models, ["id", "label"])
    known = [(name, kind, model) for (_, name, kind, _), model in zip(kinds, models)]
    return with_fits(scored, kinds, "fit int, dataset string, experiment string, n_features int", models), known
