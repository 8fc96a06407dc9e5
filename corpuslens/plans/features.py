"""Feature extraction as one fitted plan: row features, corpus features, vectors."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import LEXICAL, PRONOUNS, lexical_features, pronoun_columns
from corpuslens.functions.vectors import sparse, stored_vectors
from corpuslens.operators.dictionaries import (
    WORD_CLASSES,
    lexicon_features,
    sentiment_features,
    token_class_ratios,
)
from corpuslens.operators.embeddings import (
    attach_embeddings,
    distance_to_neutral,
    neutral_centroids,
    similarity_to,
)
from corpuslens.operators.selection import forest_importances, select_terms
from corpuslens.operators.tfidf import TfidfEstimator, TfidfModel
from corpuslens.session import in_threads, sized
from corpuslens.sources.readers import require_columns

LOGGER = logging.getLogger(__name__)

# Column names by feature group.
LEXICAL_GROUP = (*LEXICAL, "language_complexity_index")
LEXICON_GROUP = ("hate_word_count", "hate_word_ratio", "contains_hate_word")
SENTIMENT_GROUP = (
    "sentiment_polarity",
    "sentiment_subjectivity",
    "sentiment_magnitude",
    "sentiment_negative",
    "sentiment_neutral",
    "sentiment_positive",
    "sentiment_very_negative",
    "sentiment_very_positive",
    "highly_subjective",
    "highly_objective",
)
RATIO_COLUMNS = (*WORD_CLASSES.values(), *[f"{word}_ratio" for word in PRONOUNS])
EMBEDDING_SCORES = ("hate_lexicon_similarity", "embedding_distance_to_neutral")
DENSE_COLUMNS = (
    *LEXICAL_GROUP, *LEXICON_GROUP, *SENTIMENT_GROUP, *RATIO_COLUMNS, *EMBEDDING_SCORES,
)
GROUPS = ("lexical", "hate_lexicon", "sentiment", "embedding", "tfidf")

# Sources of the one-hot columns.
SOURCES = ("twitter", "reddit", "4chan")


GROUP_OF_COLUMN = {
    **dict.fromkeys(LEXICAL_GROUP, "lexical"),
    **dict.fromkeys(LEXICON_GROUP, "hate_lexicon"),
    **dict.fromkeys(SENTIMENT_GROUP, "sentiment"),
}
GROUP_OF_PREFIX = {"tfidf": "tfidf", "sentiment": "sentiment"}


def feature_group(column: str) -> str:
    """Group of a feature column by its name; an unknown name counts as embedding."""
    prefix = column.partition("_")[0]
    return GROUP_OF_COLUMN.get(column) or GROUP_OF_PREFIX.get(prefix, "embedding")


def identify_feature_groups(columns: list[str]) -> dict[str, list[str]]:
    """Feature columns, i.e. all but ``label``, by group."""
    features = [c for c in columns if c != "label"]
    return {group: [c for c in features if feature_group(c) == group] for group in GROUPS}


def source_one_hot(dataset: Column, sources: tuple[str, ...] = SOURCES) -> dict[str, Column]:
    return {f"source_{s}": F.when(dataset == s, 1).otherwise(0) for s in sources}


@dataclass(frozen=True)
class Dictionaries:
    """User tables: ``(term)``, ``(word, polarity, subjectivity)``, ``(word, class)``."""

    lexicon: DataFrame
    polarity: DataFrame
    classes: DataFrame


def row_features(df: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """All features that need nothing but the row and the dictionaries."""
    rows = lexical_features(df)
    rows = lexicon_features(rows, dictionaries.lexicon)
    rows = sentiment_features(rows, dictionaries.polarity)
    rows = token_class_ratios(rows, dictionaries.classes)
    return rows.withColumns(pronoun_columns(F.col("tokens")))


@dataclass(frozen=True)
class Settings:
    max_tfidf_features: int = 10_000
    tfidf_selection_method: str = "random_forest"
    tfidf_n_selected: int = 1000
    trees: int = 100
    depth: int = 10
    seed: int = 42
    parallel_fits: int = 8


@dataclass(frozen=True)
class Vectors:
    """Precomputed embeddings ``(id, embedding)`` and those of the lexicon's terms."""

    rows: DataFrame
    lexicon_centroid: DataFrame
    size: int
    keys: tuple[str, ...] = ("id",)


@dataclass
class FeatureExtractor(Estimator):
    """Learns TF-IDF, its selected terms and the neutral centroid per ``group_col``.

    What is learned comes only from the rows given to ``fit``.
    """

    dictionaries: Dictionaries
    vectors: Vectors
    settings: Settings = field(default_factory=Settings)
    group_col: str = "dataset"

    def __post_init__(self):
        super().__init__()

    __hash__ = object.__hash__

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        require_columns(dataset, self.group_col, "id", "text", "label")
        tfidf = TfidfEstimator(self.settings.max_tfidf_features, self.group_col).fit(dataset)
        located = attach_embeddings(
            dataset, self.vectors.rows, list(self.vectors.keys), self.vectors.size
        )
        neutral = sized(neutral_centroids(located, self.group_col))
        selected = self._select(dataset, tfidf)
        return FeatureModel(self, tfidf, selected, neutral)

    def fixed(self, dataset: DataFrame) -> DataFrame:
        """Rows with ``embedding`` and every dense column that does not depend on what is learned, without their texts."""
        vectors = self.vectors
        rows = row_features(dataset, self.dictionaries)
        rows = attach_embeddings(rows, vectors.rows, list(vectors.keys), vectors.size)
        rows = similarity_to(rows, vectors.lexicon_centroid, "hate_lexicon_similarity")
        return rows.drop("text", "clean", "tokens")

    def _select(self, dataset: DataFrame, tfidf: TfidfModel) -> DataFrame:
        """``(group, term, index, importance, rank)`` of the TF-IDF columns to keep."""
        group, settings = self.group_col, self.settings
        terms = tfidf.state.select(group, "term", "index")
        if settings.tfidf_selection_method != "random_forest":
            if settings.tfidf_selection_method != "none":
                LOGGER.warning(
                    "unknown selection method %r: all terms are kept",
                    settings.tfidf_selection_method,
                )
            return terms.withColumns(
                {"importance": F.lit(None).cast("double"), "rank": F.col("index") + 1}
            )
        vectors = tfidf.transform_sparse(dataset)
        empty = sparse(F.lit(0), F.array(), F.array())
        train = stored_vectors(
            vectors.join(dataset.select(group, "id", "label"), [group, "id"]).select(
                group, "id", "label", F.coalesce("tfidf", empty).alias("tfidf")
            ),
            ["tfidf"],
            "selection",
            group,
        )

        def importances(name: str) -> DataFrame:
            found = forest_importances(
                train.filter(F.col(group) == name),
                trees=settings.trees,
                depth=settings.depth,
                seed=settings.seed,
            )
            return found.withColumn(group, F.lit(name))

        names = sorted(tfidf.sizes())
        found = in_threads(dataset.sparkSession, importances, names, settings.parallel_fits)
        scored = reduce(DataFrame.unionByName, found)
        return sized(
            select_terms(terms.join(scored, [group, "index"]), settings.tfidf_n_selected, group)
        )

    def fit_transform(self, dataset: DataFrame) -> tuple[FeatureModel, DataFrame]:
        model = self.fit(dataset)
        return model, model.transform(dataset)


class FeatureModel(Model):
    """Fitted state; ``transform`` needs no labels."""

    def __init__(
        self,
        settings: FeatureExtractor,
        tfidf: TfidfModel,
        selected: DataFrame,
        neutral: DataFrame,
    ):
        super().__init__()
        self.plan = settings
        self.tfidf = tfidf
        self.selected = selected
        self.neutral = neutral
        self.group_col = settings.group_col
        kept = selected.select(self.group_col, "term", "index").toArrow().to_pylist()
        # One column space for all groups, in alphabetic order.
        self.terms = sorted({row["term"] for row in kept})
        self.selected_per_group: dict[str, int] = {}
        place = {term: i for i, term in enumerate(self.terms)}
        moves = {name: [-1] * size for name, size in tfidf.sizes().items()}
        for row in kept:
            name = row[self.group_col]
            moves[name][row["index"]] = place[row["term"]]
            self.selected_per_group[name] = self.selected_per_group.get(name, 0) + 1
        self.moves = pa.table(
            {
                self.group_col: pa.array(list(moves), pa.string()),
                "moves": pa.array(list(moves.values()), pa.list_(pa.int32())),
            }
        )

    def dense(self, dataset: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
        """Every feature column but TF-IDF; missing values are 0. ``fixed`` are the extractor's ``fixed(dataset)``, if at hand."""
        rows = self.plan.fixed(dataset) if fixed is None else fixed
        rows = distance_to_neutral(rows, self.neutral, self.group_col)
        return rows.fillna(0, list(DENSE_COLUMNS))

    def selected_tfidf(self, dataset: DataFrame) -> DataFrame:
        """``(group, id, tfidf)``: unit-length weights cut to the selected terms.

        Column numbers are moved by array lookup inside the row; both numberings are
        alphabetic, so the order of the cells is kept.
        """
        group = self.group_col
        moves = dataset.sparkSession.createDataFrame(self.moves)
        joined = self.tfidf.transform_sparse(dataset).join(moves, group)
        cells = F.filter(
            F.zip_with(
                "tfidf.indices",
                "tfidf.values",
                lambda i, v: F.struct(F.get("moves", i).alias("i"), v.alias("v")),
            ),
            lambda c: c["i"] >= 0,
        )
        return joined.select(group, "id", cells.alias("cells")).select(
            group, "id", sparse(F.lit(len(self.terms)), F.col("cells.i"), F.col("cells.v")).alias("tfidf")
        )

    def _transform(self, dataset: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
        """Named dense columns, ``embedding`` and the sparse ``tfidf`` cells per row."""
        empty = sparse(F.lit(len(self.terms)), F.array(), F.array())
        keys = [self.group_col, "id"]
        return (
            self.dense(dataset, fixed)
            .join(self.selected_tfidf(dataset), keys, "left")
            .withColumn("tfidf", F.coalesce("tfidf", empty))
        )

    def store(self, dataset: DataFrame, *partition_by: str, fixed: DataFrame | None = None) -> DataFrame:
        """One vector per feature group and row, written to the shared folder. ``fixed`` as for :meth:`dense`."""

        def vector(columns: tuple[str, ...]) -> Column:
            return array_to_vector(F.array(*[F.col(c).cast("double") for c in columns]))

        scores = F.array(
            *[F.col(c).cast("double") for c in (*RATIO_COLUMNS, *EMBEDDING_SCORES)]
        )
        features = self._transform(dataset, fixed)
        keep = [c for c in dataset.columns if c != "text"]
        grouped = features.select(
            *keep,
            vector(LEXICAL_GROUP).alias("lexical"),
            vector(LEXICON_GROUP).alias("hate_lexicon"),
            vector(SENTIMENT_GROUP).alias("sentiment"),
            array_to_vector(
                F.concat(scores, F.col("embedding").cast("array<double>"))
            ).alias("embedding"),
            "tfidf",
        )
        return stored_vectors(grouped, list(GROUPS), "features", *partition_by)

    def dense_size(self) -> int:
        """Columns of all feature groups but the last, TF-IDF: the first ones of an assembled vector."""
        return sum(size for group, size in self.group_sizes("").items() if group != "tfidf")

    def group_sizes(self, group: str) -> dict[str, int]:
        """Number of feature columns per feature group, for one fitted group of rows."""
        return {
            "lexical": len(LEXICAL_GROUP),
            "hate_lexicon": len(LEXICON_GROUP),
            "sentiment": len(SENTIMENT_GROUP),
            "embedding": len(RATIO_COLUMNS) + len(EMBEDDING_SCORES) + self.plan.vectors.size,
            "tfidf": self.selected_per_group.get(group, 0),
        }


def assemble(store: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """Concatenate the vectors of the given feature groups into ``features``."""
    wide = VectorAssembler(inputCols=list(groups), outputCol="features").transform(store)
    return wide.drop(*GROUPS)


def extract_features(
    df: DataFrame, extractor: FeatureExtractor, model: FeatureModel | None = None
) -> DataFrame:
    """Features of ``df`` from a fitted model, or from one fitted on ``df`` itself."""
    return (model or extractor.fit(df)).transform(df)
