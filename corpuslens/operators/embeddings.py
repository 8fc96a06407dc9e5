"""Embedding features: encoding, centroids, similarities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.vectors import cosine_distance, cosine_similarity, mean_vector
from corpuslens.session import sized


def attach_embeddings(df: DataFrame, embeddings: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Join precomputed vectors by key; rows without one get the zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return df.join(embeddings.select(*keys, "embedding"), keys, "left").withColumn(
        "embedding", F.coalesce("embedding", zero)
    )


def encode_word2vec(df: DataFrame, size: int = 64, seed: int = 42, **params) -> DataFrame:
    """Document vectors from word vectors learned on the ``tokens`` of ``df``."""
    params.setdefault("numPartitions", df.sparkSession.sparkContext.defaultParallelism)
    stage = Word2Vec(
        inputCol="tokens", outputCol="_vector", vectorSize=size, seed=seed, **params
    )
    encoded = stage.fit(df).transform(df)
    return encoded.withColumn(
        "embedding", vector_to_array("_vector", dtype="float32")
    ).drop("_vector")


def encode_with(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    text_col: str = "clean",
    batch_size: int = 64,
) -> DataFrame:
    """Encode a text column with a user model, built once per task, in Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                vectors = np.asarray(encoder(part[text_col].tolist()), dtype="float32")
                yield part.assign(embedding=list(vectors))

    return df.mapInPandas(encode, schema)


def centroids(
    df: DataFrame, keys: list[str], array: str = "embedding", weight: str | None = None
) -> DataFrame:
    """Mean vector per key; partial sums are combined before the shuffle.

    A 0/1 ``weight`` picks rows like a filter would, but Catalyst cannot move it in
    front of a repartition of the rows it is computed from.
    """
    mean = mean_vector(F.col(array), F.col(weight).cast("double") if weight else None)
    return df.groupBy(*keys).agg(mean.alias("centroid"))


def similarity_to(df: DataFrame, centroid: DataFrame, name: str, array: str = "embedding") -> DataFrame:
    """Cosine of each row's vector to a one-row ``centroid`` table.

    The row is settled first: as a scalar subquery it is then a constant of the plan.
    """
    center = sized(centroid.select("centroid"), 1).scalar()
    return (
        df.withColumn("_center", center)
        .withColumn(name, F.coalesce(cosine_similarity(F.col(array), F.col("_center")), F.lit(0.0)))
        .drop("_center")
    )


def neutral_centroids(df: DataFrame, group: str = "dataset", label: str = "label") -> DataFrame:
    return centroids(df.filter(F.col(label) == 0), [group])


def distance_to_neutral(
    df: DataFrame, neutral: DataFrame, group: str = "dataset", array: str = "embedding"
) -> DataFrame:
    """Cosine distance to the mean neutral vector of the row's group; null without one."""
    joined = df.join(sized(neutral), group, "left")
    return joined.withColumn(
        "embedding_distance_to_neutral", cosine_distance(F.col(array), F.col("centroid"))
    ).drop("centroid")
