"""Lexicon preparation: plurals, spelling variants, filter, distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_plurals(terms: DataFrame) -> DataFrame:
    """Each term and, unless it ends in ``s``, its plural; one pass, no self-union."""
    term = F.col("term")
    forms = F.when(term.endswith("s"), F.array(term)).otherwise(
        F.array(term, F.concat(term, F.lit("s")))
    )
    return terms.select(F.explode(forms).alias("term"))


def variant_terms(variants: DataFrame) -> DataFrame:
    """Flatten ``(base, variants array<string>)``; every listed variant counts."""
    return variants.select(F.explode("variants").alias("term"))


def meaningful(terms: DataFrame) -> DataFrame:
    """Keep terms longer than two characters that are all letters or hold a space."""
    term = F.col("term")
    return terms.filter((F.length(term) > 2) & (term.rlike(r"^\p{L}+\z") | term.contains(" ")))


def build_lexicon(base: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Distinct lower-case terms from base terms, their plurals and listed variants.

    The filter runs before the only shuffle, the final ``distinct``, which combines on
    the map side. Ordering belongs to the sink.
    """
    terms = with_plurals(base.select("term"))
    if variants is not None:
        terms = terms.unionByName(variant_terms(variants))
    return meaningful(terms).select(F.lower("term").alias("term")).distinct()
