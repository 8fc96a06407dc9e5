"""Inputs of the registered queries: the given tables and the user dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import with_tokens
from corpuslens.operators.dictionaries import lexicon_features
from corpuslens.operators.embeddings import centroids
from corpuslens.plans.ablation import EXPERIMENTS as ABLATIONS
from corpuslens.plans.features import Dictionaries, Vectors
from corpuslens.sources.readers import spread

# User dictionaries. They stand for the tables a user would supply.
LEXICON = (
    "clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash",
    "worthless",
)
POLARITY = (
    ("best", 1.0, 0.3), ("clown", -0.3, 0.5), ("disgusting", -1.0, 1.0), ("idiot", -0.8, 0.8),
    ("loser", -0.6, 0.75), ("moron", -0.8, 0.9), ("pathetic", -1.0, 1.0), ("scum", -0.7, 0.85),
    ("stupid", -0.8, 1.0), ("this", 0.05, 0.1), ("trash", -0.4, 0.6), ("was", -0.05, 0.2),
    ("with", 0.15, 0.25), ("worthless", -0.9, 0.9),
)
CLASSES = (
    ("clown", "NOUN"), ("idiot", "NOUN"), ("loser", "NOUN"), ("moron", "NOUN"),
    ("scum", "NOUN"), ("trash", "NOUN"), ("eau", "NOUN"), ("is", "VERB"), ("was", "VERB"),
    ("be", "VERB"), ("are", "VERB"), ("disgusting", "ADJ"), ("pathetic", "ADJ"),
    ("stupid", "ADJ"), ("worthless", "ADJ"),
)
COUNTED_WORDS = ("they", "us", "you", "he", "it")
DATASETS = ["p0", "p1", "p2"]
EMBEDDING_SIZE = 64
SEED = 42

# Stand-ins for trained experiments: a row is positive if it has at least ``hits`` lexicon
# hits and at most ``words`` words.
EXPERIMENTS = tuple(
    zip(
        ABLATIONS,
        (1, 2, 1, 1, 3, 0, 2, 0, 0, 1, 1),
        (100000, 100000, 400, 800, 100000, 100, 800, 200, 50, 300, 100000),
    )
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def platform() -> Column:
    number = F.substring("source", 4, 10).cast("int") % 3
    return F.concat(F.lit("p"), number.cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ``dataset, id, text``."""
    rows = table(spark, sf_dir, "documents").select(
        platform().alias("dataset"), F.col("doc_id").alias("id"), "text"
    )
    return spread(rows, "id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("label")
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as ``dataset, id, text, label``."""
    return documents(spark, sf_dir).join(labels(spark, sf_dir), "id").select(
        "dataset", "id", "text", "label"
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as ``dataset, id, text``."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("dataset"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        "text",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in LEXICON], "term string")


def dictionaries(spark: SparkSession) -> Dictionaries:
    return Dictionaries(
        lexicon(spark),
        spark.createDataFrame(
            list(POLARITY), "word string, polarity double, subjectivity double"
        ),
        spark.createDataFrame(list(CLASSES), "word string, class string"),
    )


def large_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the words of all documents, with scores and classes that follow their lengths."""
    words = with_tokens(documents(spark, sf_dir)).select(F.explode("tokens").alias("word")).distinct()
    size = F.length("word")
    return words.filter(size % 2 == 0).select(
        "word",
        (size % 7 / 4 - 0.75).alias("polarity"),
        (size % 5 / 4).alias("subjectivity"),
        F.element_at(F.array(*map(F.lit, ("NOUN", "VERB", "ADJ", "OTHER"))), (size / 2 % 4 + 1).cast("int")).alias("class"),
    )


def lexicon_hits(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows with tokens and lexicon features."""
    return lexicon_features(with_tokens(rows), lexicon(spark))


def lexicon_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of the documents in which the lexicon occurs."""
    marked = lexicon_hits(spark, documents(spark, sf_dir)).select("id", "contains_hate_word")
    located = embeddings(spark, sf_dir).join(marked, "id")
    return centroids(located, [], weight="contains_hate_word")


def vectors(spark: SparkSession, sf_dir: str) -> Vectors:
    return Vectors(
        embeddings(spark, sf_dir), lexicon_centroid(spark, sf_dir), EMBEDDING_SIZE
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents scored without a model: hit ratio, and any hit as prediction."""
    return lexicon_hits(spark, posts(spark, sf_dir)).select(
        "dataset",
        "id",
        "label",
        F.col("contains_hate_word").alias("prediction"),
        F.col("hate_word_ratio").alias("score"),
        F.col("hate_word_count").alias("hits"),
        F.size("tokens").alias("words"),
    )
