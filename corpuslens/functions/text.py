"""Row-level text features as Column expressions.

Everything but ``syllable_total`` is built from JVM string functions; no Python runs per
row. Counting the characters of a class is done by deleting its complement and taking the
length: ``regexp_count`` would allocate one string per match. Syllables are so many that they
are counted in numpy, over all characters of an Arrow batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that define the cleaned text.
URL = r"(?U)(https?://|www\.)[^\s\x1c-\x1f]+"
NOT_ALNUM = "[^a-z0-9]+"

# Pronouns with a ratio column each.
PRONOUNS = ("they", "us", "you")

# Names of the surface-level features, in output order.
LEXICAL = (
    "num_words",
    "avg_word_len",
    "uppercase_ratio",
    "exclamation_ratio",
    "question_ratio",
    "period_ratio",
    "punctuation_count",
    "multiple_count",
    "char_count",
    "repeated_chars",
    "unique_words",
    "word_repetition",
    "longest_word_length",
    "shortest_word_length",
)

VOWELS = "[aeiouy]"

# What a byte of a cleaned text is.
_SPACE, _VOWEL, _CONSONANT, _DIGIT = range(4)
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = _CONSONANT
_KINDS[list(b"aeiouy")] = _VOWEL
_KINDS[list(b"0123456789")] = _DIGIT


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression that refers to it per element."""
    return F.transform(F.array(value), body)[0]


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` with 0.0 where the denominator is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def clean_text(text: Column) -> Column:
    """Lower-case, drop URLs, keep ``[a-z0-9]`` and single spaces.

    Most texts hold no URL; a substring search spares them the URL pattern.
    """
    lower = F.lower(text_or_empty(text))
    may_hold_url = lower.contains("://") | lower.contains("www.")
    no_url = F.when(may_hold_url, F.regexp_replace(lower, URL, " ")).otherwise(lower)
    return F.trim(F.regexp_replace(no_url, NOT_ALNUM, " "))


def tokens_of(clean: Column) -> Column:
    """Whitespace tokens of a cleaned text; an empty text has none."""
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_class(text: Column, complement: str) -> Column:
    """Characters left after deleting every run that matches ``complement``."""
    return F.length(F.regexp_replace(text, complement, ""))


def punctuation_total(text: Column) -> Column:
    return count_char(text, "!") + count_char(text, "?") + count_char(text, ".")


def lexical_columns(text: Column, clean: Column, tokens: Column) -> dict[str, Column]:
    """The 14 surface features of one row."""
    chars = F.length(text)
    words = F.size(tokens)
    unique = F.size(F.array_distinct(tokens))
    lengths = F.transform(tokens, F.length)
    return {
        "num_words": words,
        # One space separates neighbouring tokens of a cleaned text.
        "avg_word_len": ratio(F.length(clean) - (words - 1), words),
        "uppercase_ratio": ratio(
            count_class(text, r"\P{IsUppercase}+"), count_class(text, r"\P{L}+")
        ),
        "exclamation_ratio": ratio(count_char(text, "!"), chars),
        "question_ratio": ratio(count_char(text, "?"), chars),
        "period_ratio": ratio(count_char(text, "."), chars),
        "punctuation_count": punctuation_total(text),
        "multiple_count": F.regexp_count(text, F.lit("[!?.]{2,}")),
        "char_count": chars,
        "repeated_chars": F.regexp_count(text, F.lit(r"(?d)(.)\1{2,}")),
        "unique_words": unique,
        "word_repetition": words - unique,
        "longest_word_length": F.coalesce(F.array_max(lengths), F.lit(0)),
        "shortest_word_length": F.coalesce(F.array_min(lengths), F.lit(0)),
    }


def syllables(word: Column) -> Column:
    """Estimated syllables of one word: vowel groups, silent final ``e``, at least one."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(letters, F.lit(VOWELS + "+"))
    silent = F.when(letters.endswith("e") & (groups > 1), 1).otherwise(0)
    return F.when(letters == "", 0).otherwise(F.greatest(groups - silent, F.lit(1)))


def syllable_total(clean: Column) -> Column:
    """Sum of ``syllables`` over the tokens of a cleaned text, without splitting it.

    Vowel groups of the whole text, less one per word that ends in ``e`` after an
    earlier group, plus one per word that has letters but no vowel.
    """
    # Ending in a space, no two texts of a batch touch.
    return _syllables(F.concat(clean, F.lit(" ")))


@F.arrow_udf(T.IntegerType())
def _syllables(texts: pa.Array) -> pa.Array:
    counts = syllable_counts(texts.drop_null())
    if not texts.null_count:
        return pa.array(counts, pa.int32())
    out = np.zeros(len(texts), np.int32)
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    out[known] = counts
    return pa.array(out, pa.int32(), mask=~known)


def syllable_counts(texts: pa.Array) -> np.ndarray:
    """``syllable_total`` of texts that end in a space each."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return np.zeros(len(texts), np.int64)
    chars = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    kind = _KINDS[chars]
    letters = kind != _DIGIT
    # Where each text ends among the characters that are no digits.
    ends = np.r_[0, np.cumsum(letters)][ends - ends[0]]
    chars, kind = chars[letters], kind[letters]
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    runs = kind[starts]
    last = chars[np.r_[starts[1:], len(chars)] - 1]
    before = [np.r_[np.full(k, _SPACE, runs.dtype), runs[:-k]][: len(runs)] for k in (1, 2)]
    after = np.r_[runs[1:], _SPACE]
    vowels = runs == _VOWEL
    silent = vowels & (last == ord("e")) & (after == _SPACE) & (before[0] == _CONSONANT) & (before[1] == _VOWEL)
    voiceless = (runs == _CONSONANT) & (before[0] == _SPACE) & (after == _SPACE)
    found = np.r_[0, np.cumsum(vowels.astype(np.int64) - silent + voiceless)]
    return np.diff(found[np.searchsorted(starts, ends)])


def language_complexity(text: Column, clean: Column, tokens: Column) -> Column:
    """Grade-level estimate from sentence, word and syllable counts."""
    one = F.lit(1)
    sentences = F.greatest(one, punctuation_total(text)).cast("double")
    words = F.greatest(one, F.size(tokens)).cast("double")
    spoken = F.greatest(one, syllable_total(clean)).cast("double")
    # Coefficients of the readability formula.
    return F.lit(0.39) * (words / sentences) + F.lit(11.8) * (spoken / words) - F.lit(15.59)


def pronoun_columns(
    tokens: Column, words: tuple[str, ...] = PRONOUNS
) -> dict[str, Column]:
    total = F.size(tokens)
    return {
        f"{word}_ratio": ratio(total - F.size(F.array_remove(tokens, word)), total)
        for word in words
    }


def count_in(tokens: Column, terms: list[str]) -> Column:
    """Occurrences of tokens that belong to a short list (a hash set in the plan)."""
    if not terms:
        return F.lit(0)
    return F.size(F.filter(tokens, lambda t: t.isin(terms)))


def ngrams(tokens: Column) -> Column:
    """Unigrams of two or more characters and the bigrams of what remains."""
    kept = F.filter(tokens, lambda t: F.length(t) >= 2)
    return let(kept, _with_bigrams)


def _with_bigrams(words: Column) -> Column:
    followers = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    leaders = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(leaders, followers, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def flagged_terms(terms: Column) -> Column:
    """``array<struct<term, first>>``: every occurrence, ``first`` = 1 once per term.

    Sorting puts equal terms side by side. After an explode, counting rows gives the
    corpus count of a term and summing ``first`` its document frequency, both in one
    aggregation and without a shuffle by document.
    """
    return let(F.sort_array(terms), _flag_first)


def _flag_first(ordered: Column) -> Column:
    before = F.slice(F.concat(F.array(F.lit("")), ordered), F.lit(1), F.size(ordered))
    return F.zip_with(
        ordered,
        before,
        lambda term, prev: F.struct(term.alias("term"), (term != prev).cast("int").alias("first")),
    )


def with_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``clean`` and ``tokens``; null text becomes empty."""
    return (
        df.withColumn(text_col, text_or_empty(F.col(text_col)))
        .withColumn("clean", clean_text(F.col(text_col)))
        .withColumn("tokens", tokens_of(F.col("clean")))
    )


def lexical_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the surface features and the readability index to each row."""
    rows = with_tokens(df, text_col)
    text, clean, tokens = F.col(text_col), F.col("clean"), F.col("tokens")
    return rows.withColumns(
        {
            **lexical_columns(text, clean, tokens),
            "language_complexity_index": language_complexity(text, clean, tokens),
        }
    )
