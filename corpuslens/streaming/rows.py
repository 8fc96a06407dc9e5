"""Row features on a stream.

They are stateless, so the batch expressions apply unchanged: no watermark, no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpuslens.plans.features import Dictionaries, row_features


def read_posts(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def write_row_features(
    posts: DataFrame,
    dictionaries: Dictionaries,
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append the features of all available posts to ``path``; exactly once per file.

    Raises before the start if a dictionary is too large for a stream.
    """
    features = row_features(posts, dictionaries).drop("clean", "tokens")
    return (
        features.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
