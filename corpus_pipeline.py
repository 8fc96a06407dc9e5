"""From raw documents to token ids, as stages that each read what the one before wrote.

Defined results, the same for all five stages: a null text is an empty text and is kept unless it is a copy of another
(exact copies: the row with the largest id stays, and of rows that repeat with id and text one; near copies and benchmark
items: an empty text links with nothing and holds nothing; tokens: none). A null id is the smallest id for exact copies and
links with nothing for near copies. Ties are decided by id alone. Very long texts are read whole. An empty table stays
empty. All columns of the documents, extra ones too, go through the first four stages unchanged whatever their names; the
last returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import bpe, decontaminate, exact, jaccard, toxicity
from corpuslens.llm.common import small_batches, table
from corpuslens.llm.queries import REJECT, VOCABULARY, token_digests, toxicity_model
from corpuslens.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold of rejection."""
    small_batches(spark)
    model = toxicity_model(spark, sf_dir, table(spark, sf_dir, "documents"))
    return docs.where(toxicity.score_column(model)(F.col("text")) < REJECT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that with the largest id."""
    return exact.keep_first(docs, exact.DigestIndex(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed, 32 bits each) and digests of the ids and of the text decoded from them."""
    small_batches(spark)
    path = public_tokenizers.path(VOCABULARY)
    return token_digests(bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The first and last stage learn from labels and tokenize; SQL cannot express them.
ORACLE_SQL = None
