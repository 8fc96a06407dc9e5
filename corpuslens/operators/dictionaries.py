"""Features that look tokens up in user dictionaries.

A dictionary that fits the bound below becomes a literal hash set, so membership is
tested inside the row and nothing is shuffled. A larger one is joined to the tokens of
each distinct token list, and the totals come back by the list; this needs no key of the
rows. Both ways give the same columns. Entries with a null are dropped, a word listed
twice with a value is refused, and a stream takes only dictionaries within the bound.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import count_in, ratio
from corpuslens.session import sized, small_table

INLINE_TERMS = 10_000
INLINE_SCORES = 128

# Word classes with a ratio column each.
WORD_CLASSES = {"NOUN": "noun_ratio", "VERB": "verb_ratio", "ADJ": "adj_ratio"}

# Scores are summed as decimals: exact, whatever the order of the rows.
EXACT = "decimal(18,6)"


def _settled(dictionary: DataFrame, *values: str) -> DataFrame:
    """Entries without nulls; a word listed twice has no one meaning and is refused."""
    rows = dictionary.select("word", *values).dropna()
    twice = rows.groupBy("word").count().filter("count > 1").limit(5).collect()
    if twice:
        names = ", ".join(sorted(repr(r["word"]) for r in twice))
        raise ValueError(f"words listed more than once in the dictionary: {names}")
    return rows


def _with_totals(df: DataFrame, dictionary: DataFrame, *totals: Column) -> DataFrame:
    """Add ``totals`` over the matches of each row's tokens; null for a row without any.

    ``_n`` is how often a matched word stands in the row.
    """
    if df.isStreaming:
        raise ValueError("this dictionary is too large for a stream: rows cannot be joined by token there")
    # 16 bytes, as every word of a list is shuffled with them.
    keyed = df.withColumn("_list", F.unhex(F.substring(F.sha2(F.concat_ws(" ", "tokens"), 256), 1, 32)))
    lists = keyed.select("_list", "tokens").dropDuplicates(["_list"])
    words = lists.select("_list", F.explode("tokens").alias("word"))
    counts = words.groupBy("_list", "word").agg(F.count("*").alias("_n"))
    found = counts.join(sized(dictionary), "word").groupBy("_list").agg(*totals)
    return keyed.join(found, "_list", "left").drop("_list")


def lexicon_columns(hits: Column, tokens: Column) -> dict[str, Column]:
    return {
        "hate_word_count": hits,
        "hate_word_ratio": ratio(hits, F.size(tokens)),
        "contains_hate_word": (hits > 0).cast("int"),
    }


def lexicon_features(
    df: DataFrame, lexicon: DataFrame, inline_terms: int = INLINE_TERMS
) -> DataFrame:
    """Add lexicon hit count, ratio and flag to rows that carry ``tokens``.

    Matching is by single token, so terms that hold a space cannot match and are left
    out of the lookup.
    """
    terms = lexicon.select("term").dropna().filter(~F.col("term").contains(" ")).distinct()
    table = small_table(terms, inline_terms)
    tokens = F.col("tokens")
    if table is not None:
        hits = count_in(tokens, sorted(table["term"].to_pylist()))
        return df.withColumns(lexicon_columns(hits, tokens))
    words = terms.select(F.col("term").alias("word"))
    rows = _with_totals(df, words, F.sum("_n").cast("int").alias("_hits"))
    hits = F.coalesce(F.col("_hits"), F.lit(0))
    return rows.withColumns(lexicon_columns(hits, tokens)).drop("_hits")


def sentiment_columns(polarity: Column, subjectivity: Column) -> dict[str, Column]:
    """Scores and flags. The thresholds."""

    def flag(condition: Column) -> Column:
        return condition.cast("int")

    return {
        "sentiment_polarity": polarity,
        "sentiment_subjectivity": subjectivity,
        "sentiment_magnitude": F.abs(polarity),
        "sentiment_negative": flag(polarity < -0.1),
        "sentiment_neutral": flag(polarity.between(-0.1, 0.1)),
        "sentiment_positive": flag(polarity > 0.1),
        "sentiment_very_negative": flag(polarity < -0.5),
        "sentiment_very_positive": flag(polarity > 0.5),
        "highly_subjective": flag(subjectivity > 0.7),
        "highly_objective": flag(subjectivity < 0.3),
    }


def _inline_mean(table: pa.Table, name: str) -> Column:
    """Mean score of ``_matched`` from literal word sets, one per distinct score.

    Scores are held as integers of 1e-6, so the sum is exact.
    """
    words: dict[int, list[str]] = {}
    for word, value in zip(table["word"].to_pylist(), table[name].to_pylist()):
        words.setdefault(int(value * 10**6), []).append(word)
    total = F.lit(0).cast("bigint")
    for value, members in sorted(words.items()):
        total = total + count_in(F.col("_matched"), members) * F.lit(value)
    return ratio(total / F.lit(10.0**6), F.size("_matched"))


def sentiment_features(
    df: DataFrame,
    dictionary: DataFrame,
    inline_terms: int = INLINE_TERMS,
    inline_scores: int = INLINE_SCORES,
) -> DataFrame:
    """Mean polarity and subjectivity of the matched tokens, 0.0 if none match.

    ``dictionary`` is ``(word, polarity, subjectivity)``; scores count to six decimals.
    """
    names = ("polarity", "subjectivity")
    scores = _settled(
        dictionary.select("word", *[F.col(n).cast(EXACT).alias(n) for n in names]), *names
    )
    table = small_table(scores, inline_terms)
    if table is not None and sum(len(table[n].unique()) for n in names) <= inline_scores:
        known = sorted(table["word"].to_pylist())
        matched = F.filter("tokens", lambda t: t.isin(known)) if known else F.slice("tokens", 1, 0)
        scored = df.withColumn("_matched", matched).withColumns(
            {f"_{n}": _inline_mean(table, n) for n in names}
        )
    else:
        means = [
            F.try_divide(F.sum(F.col(n) * F.col("_n")).cast("double"), F.sum("_n")).alias(f"_{n}")
            for n in names
        ]
        scored = _with_totals(df, scores, *means).withColumns(
            {f"_{n}": F.coalesce(F.col(f"_{n}"), F.lit(0.0)) for n in names}
        )
    return scored.withColumns(
        sentiment_columns(F.col("_polarity"), F.col("_subjectivity"))
    ).drop("_matched", "_polarity", "_subjectivity")


def token_class_ratios(
    df: DataFrame, classes: DataFrame, inline_terms: int = INLINE_TERMS
) -> DataFrame:
    """Share of tokens per word class; ``classes`` is ``(word, class)``."""
    known = _settled(classes, "class").filter(F.col("class").isin(*WORD_CLASSES))
    table = small_table(known, inline_terms)
    total = F.size("tokens")
    if table is not None:
        words: dict[str, list[str]] = {name: [] for name in WORD_CLASSES}
        for word, name in zip(table["word"].to_pylist(), table["class"].to_pylist()):
            words[name].append(word)
        return df.withColumns(
            {
                column: ratio(count_in(F.col("tokens"), sorted(words[name])), total)
                for name, column in WORD_CLASSES.items()
            }
        )
    totals = [
        F.sum(F.when(F.col("class") == name, F.col("_n"))).alias(f"_{column}")
        for name, column in WORD_CLASSES.items()
    ]
    rows = _with_totals(df, known, *totals)
    return rows.withColumns(
        {
            column: ratio(F.coalesce(F.col(f"_{column}"), F.lit(0)), total)
            for column in WORD_CLASSES.values()
        }
    ).drop(*[f"_{column}" for column in WORD_CLASSES.values()])
