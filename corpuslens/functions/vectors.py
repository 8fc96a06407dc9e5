"""Vector arithmetic on array columns and the sparse layout handed to ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.session import new_table_path


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0.0 if either is the zero vector; null if one is null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norm))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def mean_vector(array: Column, weight: Column | None = None) -> Column:
    """Element-wise (weighted) mean as an aggregate with map-side combine."""
    vector = array_to_vector(array.cast("array<double>"))
    return vector_to_array(Summarizer.mean(vector, weight))


def expand(df: DataFrame, array: str, size: int, prefix: str = "embed_") -> DataFrame:
    """One column per element: ``embed_0 .. embed_{size-1}``."""
    return df.select("*", *[F.get(array, F.lit(i)).alias(f"{prefix}{i}") for i in range(size)])


def sparse(size: Column, indices: Column, values: Column) -> Column:
    """A sparse vector in the storage layout of ``VectorUDT``."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        size.cast("int").alias("size"),
        indices.cast("array<int>").alias("indices"),
        values.cast("array<double>").alias("values"),
    )


def stored_vectors(df: DataFrame, vectors: list[str], name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read the ``sparse`` columns as ML vectors.

    The fits that follow scan this table many times; partition columns let each of them
    read only its own folders.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    fields = [
        T.StructField(f.name, VectorUDT() if f.name in vectors else f.dataType) for f in df.schema
    ]
    return spark.read.schema(T.StructType(fields)).parquet(path)
