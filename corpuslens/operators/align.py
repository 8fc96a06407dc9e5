"""Fitting test features to the columns a model was trained on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import sized


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns``, in order: others are dropped, absent ones are 0."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(0).alias(c) for c in columns])


def align_terms(weights: DataFrame, train_terms: DataFrame) -> DataFrame:
    """Long form of the same: keep the terms the model knows. An absent cell is a 0."""
    return weights.join(sized(train_terms.select("term")), "term", "left_semi")
