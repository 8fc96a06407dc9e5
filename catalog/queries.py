"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as src
from corpuslens.functions import text as tx
from corpuslens.functions.vectors import expand
from corpuslens.operators import embeddings as emb
from corpuslens.operators import metrics as mx
from corpuslens.operators import reports as rp
from corpuslens.operators import splits as sp
from corpuslens.operators.align import align_terms
from corpuslens.operators.classify import fit_logistic, score
from corpuslens.operators.dictionaries import lexicon_features as dictionary_lexicon
from corpuslens.operators.dictionaries import sentiment_features, token_class_ratios
from corpuslens.operators.lexicon import build_lexicon
from corpuslens.operators.tfidf import TfidfEstimator, term_statistics
from corpuslens.plans import ablation as ab
from corpuslens.plans import regimes as rg
from corpuslens.plans.features import (
    DENSE_COLUMNS,
    EMBEDDING_SCORES,
    LEXICAL_GROUP,
    LEXICON_GROUP,
    RATIO_COLUMNS,
    SENTIMENT_GROUP,
    FeatureExtractor,
    Settings,
    assemble,
    row_features,
    source_one_hot,
)
from corpuslens.session import sized
from corpuslens.sources.readers import dataset_profile, posts_from, union_named

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEYS = ["dataset", "id"]


def query(fn):
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


# Scans ---------------------------------------------------------------------------------


@query
def load_posts(spark, sf):
    """Documents with their toxicity as the label."""
    raw = src.table(spark, sf, "documents").join(src.table(spark, sf, "labels"), "doc_id")
    rows = posts_from(raw, label_column="toxic", id_column="doc_id", dataset="documents")
    return rows.select("dataset", "id", "label", F.md5("text").alias("text_md5"))


@query
def platform_union(spark, sf):
    rows = src.documents(spark, sf)
    frames = [rows.filter(F.col("dataset") == name) for name in src.DATASETS]
    return union_named(frames).select("dataset", "id", F.length("text").alias("n_chars"))


@query
def dataset_profile_query(spark, sf):
    return rounded(dataset_profile(src.posts(spark, sf)), "positive_ratio")


# Lexicon preparation -------------------------------------------------------------------


@query
def lexicon_build(spark, sf):
    """Base terms: raw words of all documents. Variants: their digit and ``z`` spellings."""
    words = src.documents(spark, sf).select(F.explode(F.split("text", " ")).alias("term"))
    base = words.filter("term <> ''").distinct()
    variants = base.select(
        F.col("term").alias("base"),
        F.array(
            F.translate("term", "aeo", "430"), F.concat("term", F.lit("z"))
        ).alias("variants"),
    )
    return build_lexicon(base, variants)


# Row features --------------------------------------------------------------------------


@query
def clean_text(spark, sf):
    return src.documents(spark, sf).select("id", tx.clean_text(F.col("text")).alias("clean"))


@query
def tokens(spark, sf):
    rows = tx.with_tokens(src.documents(spark, sf))
    return rows.select(
        "id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens")
    )


@query
def lexical_features(spark, sf):
    rows = tx.lexical_features(src.documents(spark, sf))
    ratios = [n for n in tx.LEXICAL if n.endswith("ratio") or n.startswith("avg")]
    return rounded(rows.select("id", *tx.LEXICAL), *ratios)


@query
def syllables(spark, sf):
    words = tx.with_tokens(src.documents(spark, sf)).select(F.explode("tokens").alias("word"))
    return words.distinct().select("word", tx.syllables(F.col("word")).alias("syllables"))


@query
def readability(spark, sf):
    rows = tx.lexical_features(src.documents(spark, sf))
    return rounded(rows.select("id", "language_complexity_index"), "language_complexity_index")


@query
def lexicon_features(spark, sf):
    rows = src.lexicon_hits(spark, src.documents(spark, sf))
    return rounded(rows.select("dataset", "id", *LEXICON_GROUP), "hate_word_ratio")


@query
def sentiment(spark, sf):
    rows = sentiment_features(
        tx.with_tokens(src.documents(spark, sf)), src.dictionaries(spark).polarity
    )
    return rounded(rows.select("id", *SENTIMENT_GROUP), *SENTIMENT_GROUP[:3])


@query
def token_class_ratios_query(spark, sf):
    rows = token_class_ratios(
        tx.with_tokens(src.documents(spark, sf)), src.dictionaries(spark).classes
    )
    names = ("noun_ratio", "verb_ratio", "adj_ratio")
    return rounded(rows.select("id", *names), *names)


@query
def lexicon_features_large(spark, sf):
    """A lexicon beyond the bound of literal sets."""
    terms = src.large_dictionary(spark, sf).select(F.col("word").alias("term"))
    rows = dictionary_lexicon(tx.with_tokens(src.documents(spark, sf)), terms)
    return rounded(rows.select("dataset", "id", *LEXICON_GROUP), "hate_word_ratio")


@query
def sentiment_large(spark, sf):
    rows = sentiment_features(
        tx.with_tokens(src.documents(spark, sf)), src.large_dictionary(spark, sf)
    )
    return rounded(rows.select("id", *SENTIMENT_GROUP), *SENTIMENT_GROUP[:3])


@query
def token_classes_large(spark, sf):
    rows = token_class_ratios(
        tx.with_tokens(src.documents(spark, sf)), src.large_dictionary(spark, sf)
    )
    names = ("noun_ratio", "verb_ratio", "adj_ratio")
    return rounded(rows.select("id", *names), *names)


@query
def pronoun_ratios(spark, sf):
    ratios = tx.pronoun_columns(F.col("tokens"), src.COUNTED_WORDS)
    rows = tx.with_tokens(src.documents(spark, sf)).withColumns(ratios)
    return rounded(rows.select("id", *ratios), *ratios)


@query
def source_one_hot_query(spark, sf):
    flags = source_one_hot(F.col("dataset"), tuple(src.DATASETS))
    return src.documents(spark, sf).select("id", *[c.alias(n) for n, c in flags.items()])


@query
def label_feature_averages(spark, sf):
    """Average row features per dataset and label of the labelled documents."""
    rows = row_features(src.posts(spark, sf), src.dictionaries(spark))
    names = (*LEXICAL_GROUP, *LEXICON_GROUP, *SENTIMENT_GROUP, *RATIO_COLUMNS)
    return rows.groupBy("dataset", "label").agg(
        F.count("*").alias("n_rows"), *[r6(F.avg(n)).alias(n) for n in names]
    )


# TF-IDF --------------------------------------------------------------------------------


@query
def ngrams(spark, sf):
    return term_statistics(src.documents(spark, sf))


@query
def tfidf_vocab(spark, sf):
    model = TfidfEstimator().fit(src.documents(spark, sf))
    return model.state.select("dataset", "term", "total", "rank")


@query
def tfidf_idf(spark, sf):
    model = TfidfEstimator().fit(src.documents(spark, sf))
    return model.state.select("dataset", "term", "df", "n_rows", r6("idf").alias("idf"))


@query
def tfidf_columns(spark, sf):
    model = TfidfEstimator().fit(src.documents(spark, sf))
    return model.state.select(
        "dataset", F.concat(F.lit("tfidf_"), "term").alias("column_name"), "index"
    )


@query
def tfidf_weights(spark, sf):
    rows = src.documents(spark, sf)
    return rounded(TfidfEstimator().fit(rows).transform(rows), "weight")


@query
def tfidf_transform(spark, sf):
    model = TfidfEstimator().fit(src.documents(spark, sf))
    return rounded(model.transform(src.turns(spark, sf)), "weight")


@query
def column_alignment(spark, sf):
    """Weights of ``p1`` on the columns of a model fitted on ``p0``."""
    rows = src.documents(spark, sf)
    model = TfidfEstimator().fit(rows)
    own = model.transform(rows.filter("dataset = 'p1'"))
    known = model.state.filter("dataset = 'p0'")
    return rounded(align_terms(own, known), "weight").select("id", "term", "weight")


# Embeddings ----------------------------------------------------------------------------


@query
def precomputed_embeddings(spark, sf):
    rows = emb.attach_embeddings(
        src.documents(spark, sf), src.embeddings(spark, sf), ["id"], src.EMBEDDING_SIZE
    )
    first = F.get("embedding", F.lit(0)).cast("double")
    return rows.select(
        "dataset", "id", F.size("embedding").alias("width"), r6(first).alias("embed_0")
    )


@query
def centroid(spark, sf):
    rows = emb.centroids(src.table(spark, sf, "embeddings"), ["label"])
    return rows.select("label", F.posexplode("centroid").alias("position", "value")).select(
        "label", "position", r6("value").alias("value")
    )


@query
def cosine_to_centroid(spark, sf):
    rows = emb.similarity_to(
        src.embeddings(spark, sf), src.lexicon_centroid(spark, sf), "hate_lexicon_similarity"
    )
    return rounded(rows.drop("embedding"), "hate_lexicon_similarity")


@query
def distance_to_neutral(spark, sf):
    located = src.documents(spark, sf).drop("text").join(src.embeddings(spark, sf), "id")
    neutral = emb.neutral_centroids(located.join(src.labels(spark, sf), "id"))
    rows = emb.distance_to_neutral(located, neutral)
    return rounded(rows.drop("embedding"), "embedding_distance_to_neutral")


@query
def embedding_columns(spark, sf):
    rows = expand(src.embeddings(spark, sf), "embedding", src.EMBEDDING_SIZE)
    names = [f"embed_{i}" for i in range(src.EMBEDDING_SIZE)]
    return rows.select("id", *[r6(F.col(n).cast("double")).alias(n) for n in names])


def _letter_shares():
    """Stands for a user's text encoder: share of three letters in a text."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) / max(len(t), 1) for c in "aes"] for t in texts])

    return encode


@query
def encoded_embeddings(spark, sf):
    rows = src.documents(spark, sf).select("id", tx.clean_text(F.col("text")).alias("clean"))
    encoded = emb.encode_with(rows, _letter_shares)
    parts = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    return encoded.select("id", *[F.round(p, 4).alias(f"embed_{i}") for i, p in enumerate(parts)])


@query
def word2vec_embeddings(spark, sf):
    """Document vectors learned from all documents; zero where no word is frequent enough."""
    rows = emb.encode_word2vec(
        tx.with_tokens(src.documents(spark, sf)), size=16, seed=src.SEED, minCount=5, maxIter=1
    )
    is_zero = F.forall("embedding", lambda x: x == 0).cast("int")
    return rows.select("dataset", "id", F.size("embedding").alias("width"), is_zero.alias("is_zero"))


# Assembly ------------------------------------------------------------------------------


@query
def feature_matrix(spark, sf):
    """Dense feature groups of every document; the neutral centroid is per dataset."""
    rows = src.documents(spark, sf)
    vec = src.vectors(spark, sf)
    features = row_features(rows, src.dictionaries(spark))
    features = emb.attach_embeddings(features, vec.rows, ["id"], vec.size)
    features = emb.similarity_to(features, vec.lexicon_centroid, "hate_lexicon_similarity")
    labelled = rows.drop("text").join(vec.rows, "id").join(src.labels(spark, sf), "id")
    features = emb.distance_to_neutral(features, emb.neutral_centroids(labelled)).fillna(0)
    names = DENSE_COLUMNS
    real = [n for n, t in features.select(*names).dtypes if t == "double"]
    return rounded(features.select("dataset", "id", *names), *real)


@query
def fill_missing(spark, sf):
    """Labels of every document, absent ones filled with 0."""
    rows = src.documents(spark, sf).select("dataset", "id")
    marks = src.table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return rows.join(marks, "id", "left").fillna(0)


@query
def union_align(spark, sf):
    """Documents and turns in one table; columns only one side has are 0 on the other."""
    docs = src.documents(spark, sf).select("dataset", "id", F.length("text").alias("doc_chars"))
    said = src.turns(spark, sf).select("dataset", "id", F.length("text").alias("turn_chars"))
    return union_named([docs, said])


# Splits and weights --------------------------------------------------------------------


def _labelled(spark, sf) -> DataFrame:
    return src.posts(spark, sf).drop("text")


@query
def stratified_folds(spark, sf):
    return sp.stratified_folds(_labelled(spark, sf))


@query
def stratified_holdout(spark, sf):
    return sp.stratified_holdout(_labelled(spark, sf))


@query
def class_guard(spark, sf):
    rows = src.table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"))
    return sp.class_guard(rows.join(src.labels(spark, sf), "id"), "source").select(
        "source", "id", "label"
    )


@query
def class_weights(spark, sf):
    return rounded(sp.with_class_weights(_labelled(spark, sf)), "weight").select(
        "dataset", "id", "label", "weight"
    )


# Metrics -------------------------------------------------------------------------------


def _folded(spark, sf) -> DataFrame:
    return sp.stratified_folds(src.scored(spark, sf))


def _fold_metrics(spark, sf) -> DataFrame:
    return mx.evaluate(_folded(spark, sf), ["dataset", "fold"])


@query
def confusion(spark, sf):
    return mx.confusion(_folded(spark, sf), ["dataset", "fold"])


@query
def confusion_pooled(spark, sf):
    return mx.confusion(src.scored(spark, sf), ["dataset"])


@query
def metrics(spark, sf):
    return rounded(_fold_metrics(spark, sf), "accuracy", "precision", "recall", "f1", "roc_auc")


@query
def roc_auc(spark, sf):
    return rounded(mx.roc_auc(src.scored(spark, sf), ["dataset"]), "roc_auc")


@query
def classification_report(spark, sf):
    report = mx.classification_report(src.scored(spark, sf), ["dataset"])
    return rounded(report, "precision", "recall", "f1")


@query
def fold_summary(spark, sf):
    summary = mx.fold_summary(_fold_metrics(spark, sf), ["dataset"])
    return rounded(summary, *[c for c in summary.columns if c.endswith(("_mean", "_std"))])


@query
def cv_summary(spark, sf):
    summary = rp.cv_summary(mx.fold_summary(_fold_metrics(spark, sf), ["dataset"]))
    return summary.toDF("dataset", "f1", "accuracy", "precision", "recall")


# Reports -------------------------------------------------------------------------------


def _experiment_rows(spark, sf) -> DataFrame:
    rules = F.array(
        *[
            F.struct(F.lit(n).alias("experiment"), F.lit(h).alias("h"), F.lit(w).alias("w"))
            for n, h, w in src.EXPERIMENTS
        ]
    )
    rows = src.scored(spark, sf).withColumn("rule", F.explode(rules))
    guess = (F.col("hits") >= F.col("rule.h")) & (F.col("words") <= F.col("rule.w"))
    return rows.select(
        "dataset", "rule.experiment", "label", guess.cast("int").alias("prediction")
    )


def _experiments(spark, sf) -> DataFrame:
    counts = mx.confusion(_experiment_rows(spark, sf), ["dataset", "experiment"])
    return sized(mx.with_metrics(counts).select("dataset", "experiment", "accuracy", "f1"))


@query
def combined_results(spark, sf):
    """Per-dataset result tables in one."""
    results = _experiments(spark, sf)
    parts = [results.filter(F.col("dataset") == name) for name in src.DATASETS]
    return rounded(union_named(parts), "accuracy", "f1")


@query
def delta_f1(spark, sf):
    return rounded(rp.delta_f1(_experiments(spark, sf)), "delta_f1")


@query
def f1_pivot(spark, sf):
    return rounded(rp.f1_pivot(_experiments(spark, sf), src.DATASETS), *src.DATASETS)


@query
def group_ranking(spark, sf):
    deltas = rounded(rp.delta_f1(_experiments(spark, sf)), "delta_f1")
    return rp.group_ranking(deltas)


@query
def dense_grid(spark, sf):
    """The experiments of ``p2`` without predictions are missing and become 0."""
    results = _experiments(spark, sf).filter("dataset <> 'p2' or f1 > 0.5")
    return rounded(rp.dense_grid(results), "f1")


def _transfer(spark, sf) -> DataFrame:
    """Half the mean score of a dataset's positive rows decides on every dataset's rows."""
    rows = src.scored(spark, sf)
    limits = (
        rows.filter("label = 1")
        .groupBy("dataset")
        .agg(F.round(F.avg("score") / 2, 6).alias("lowest"))
        .agg(F.array_sort(F.collect_list(F.struct("dataset", "lowest"))).alias("limits"))
        .scalar()
    )
    tried = rows.withColumn("limit", F.explode(limits)).select(
        F.col("limit.dataset").alias("train_dataset"),
        F.col("dataset").alias("test_dataset"),
        "label",
        (F.col("score") >= F.col("limit.lowest")).cast("int").alias("prediction"),
    )
    counts = mx.confusion(tried, ["train_dataset", "test_dataset"])
    return sized(mx.with_metrics(counts).select("train_dataset", "test_dataset", "f1"))


@query
def f1_drop(spark, sf):
    return rounded(rp.f1_drop(_transfer(spark, sf)), "f1", "f1_drop_pct")


@query
def cross_pivot(spark, sf):
    wide = rp.cross_pivot(rp.f1_drop(_transfer(spark, sf)), src.DATASETS)
    return rounded(wide, *[c for c in wide.columns if c != "train_dataset"])


@query
def nested_transfer(spark, sf):
    """Metrics of each train dataset, one entry per test dataset."""
    nested = rp.nested_transfer(rp.f1_drop(_transfer(spark, sf)))
    return nested.select(
        "train_dataset", F.explode("by_test_dataset").alias("test_dataset", "m")
    ).select("train_dataset", "test_dataset", r6("m.f1").alias("f1"))


# Learning ------------------------------------------------------------------------------


def extractor(spark, sf, **settings) -> FeatureExtractor:
    return FeatureExtractor(
        src.dictionaries(spark), src.vectors(spark, sf), Settings(seed=src.SEED, **settings)
    )


@query
def extracted_features(spark, sf):
    """Fitted on the labelled documents, all terms kept, applied to every document."""
    plan = extractor(spark, sf, tfidf_selection_method="none")
    rows = plan.fit(src.posts(spark, sf)).transform(src.documents(spark, sf))
    total = F.aggregate("tfidf.values", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "dataset",
        "id",
        "num_words",
        "hate_word_count",
        *[r6(F.col(c)).alias(c) for c in EMBEDDING_SCORES],
        F.size("tfidf.indices").alias("tfidf_cells"),
        r6(total).alias("tfidf_total"),
    )


@query
def selected_terms(spark, sf):
    """TF-IDF columns kept by forest importance, per dataset."""
    model = extractor(spark, sf).fit(src.posts(spark, sf))
    return model.selected.select("dataset", "term", "rank", r6("importance").alias("importance"))


@query
def selected_features(spark, sf):
    """Number of selected cells of every document, from a model fitted on the labelled ones."""
    model = extractor(spark, sf).fit(src.posts(spark, sf))
    rows = model.selected_tfidf(src.documents(spark, sf))
    return rows.select("dataset", "id", F.size("tfidf.indices").alias("tfidf_cells"))


@query
def logistic_scores(spark, sf):
    """Trained on four folds of the labelled documents, scored on the fifth."""
    rows = sp.stratified_folds(src.posts(spark, sf))
    model = extractor(spark, sf).fit(rows.filter("fold <> 1"))
    vectors = assemble(model.store(rows, "fold"))
    fitted = fit_logistic(vectors.filter("fold <> 1"), leading=model.dense_size())
    return score(fitted, vectors.filter("fold = 1")).select(
        "dataset", "id", "label", "prediction", r6("score").alias("score")
    )


def _regime(spark, sf, *regimes: str, fit_scope: str = "all") -> DataFrame:
    scored = rg.run_regimes(
        src.posts(spark, sf), extractor(spark, sf), regimes, seed=src.SEED, fit_scope=fit_scope
    )
    summary = rg.overall_summary(scored)
    return rounded(summary, *[c for c in summary.columns if c.endswith(("_mean", "_std"))])


@query
def regime_rows(spark, sf):
    """What every evaluation and fold of the regimes tests: rows and positives."""
    return rg.planned_tests(*rg.folds_and_fits(src.posts(spark, sf), seed=src.SEED))


@query
def regime_transfer(spark, sf):
    """Train by test table of trained models, with the drop against cross-validation."""
    scored = rg.run_regimes(
        src.posts(spark, sf), extractor(spark, sf), ("cv", "cross"), seed=src.SEED, fit_scope="all"
    )
    table = rg.transfer_summary(rg.overall_summary(scored))
    return rounded(table, *[c for c in table.columns if not c.endswith("_dataset")])


@query
def regime_cv(spark, sf):
    return _regime(spark, sf, "cv")


@query
def regime_cross(spark, sf):
    return _regime(spark, sf, "cross")


@query
def regime_loo(spark, sf):
    return _regime(spark, sf, "loo")


@query
def regime_loo_train_scope(spark, sf):
    """Features learned from the training rows of each model alone."""
    return _regime(spark, sf, "loo", fit_scope="train")


@query
def regime_global(spark, sf):
    return _regime(spark, sf, "global")


@query
def overall_summary(spark, sf):
    return _regime(spark, sf, *rg.REGIMES)


@query
def ablation(spark, sf):
    results = ab.run_ablation(src.posts(spark, sf), extractor(spark, sf), seed=src.SEED)
    return rounded(results, "accuracy", "precision", "recall", "f1", "roc_auc")


def _row_experiments(spark, sf):
    """The ablation's experiments on row features alone, fitted to the last digits."""
    store, sizes = ab.row_store(ab.holdout(src.posts(spark, sf), seed=src.SEED), src.dictionaries(spark))
    experiments = {name: groups for name, groups in ab.EXPERIMENTS.items() if groups[0] in sizes and len(groups) == 1}
    return ab.score_experiments(store, dict.fromkeys(src.DATASETS, sizes), experiments, tolerance=1e-14)


@query
def logistic_weights(spark, sf):
    """Weights of the models with 15, 3 and 10 columns; column 0 is the intercept."""
    _, models = _row_experiments(spark, sf)
    groups = {"lexical": 15, "hate_lexicon": 3, "sentiment": 10}
    rows = []
    for dataset, experiment, model in models:
        start = 0
        for group, size in groups.items():
            if (group,) == ab.EXPERIMENTS[experiment]:
                weights = [model.intercept, *model.coefficients[start : start + size].tolist()]
                rows += [(dataset, experiment, i, w) for i, w in enumerate(weights)]
            start += size
    return rounded_to(spark.createDataFrame(rows, "dataset string, experiment string, place int, weight double"), 4, "weight")


@query
def logistic_predictions(spark, sf):
    """Held-out rows under these models."""
    scored, _ = _row_experiments(spark, sf)
    return rounded_to(scored.select("dataset", "experiment", "id", "label", "prediction", "score"), 4, "score")


@query
def row_ablation(spark, sf):
    """Metrics of these models on the held-out rows."""
    scored, _ = _row_experiments(spark, sf)
    counts = mx.confusion(scored, ["dataset", "experiment", "n_features"])
    return rounded(mx.with_metrics(counts), "accuracy", "precision", "recall", "f1")


def rounded_to(df: DataFrame, digits: int, *names: str) -> DataFrame:
    # Adding 0 makes -0 a plain 0.
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})
