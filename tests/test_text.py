import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as tx

# text, clean, values in the order of NAMES
NAMES = [
    "num_words", "avg_word_len", "uppercase_ratio", "exclamation_ratio", "question_ratio",
    "period_ratio", "punctuation_count", "multiple_count", "char_count", "repeated_chars",
    "unique_words", "word_repetition", "longest_word_length", "shortest_word_length",
    "language_complexity_index", "they_ratio", "us_ratio", "you_ratio",
]
ROWS = [
    ("", "", [0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 0, 0, -3.4, 0, 0, 0]),
    ("!!!", "", [0, 0.0, 0.0, 1.0, 0.0, 0.0, 3, 1, 3, 1, 0, 0, 0, 0, -3.66, 0, 0, 0]),
    ("Hello!!! WORLD?? aaa...", "hello world aaa",
     [3, 4.333333, 0.461538, 0.130435, 0.086957, 0.130435, 8, 3, 23, 3, 3, 0, 5, 3, 0.289583, 0, 0, 0]),
    ("See https://x.y/z?q=1 NOW", "see now",
     [2, 3.0, 0.266667, 0.0, 0.04, 0.04, 2, 0, 25, 0, 2, 0, 3, 3, -3.4, 0, 0, 0]),
    ("café ÉtÉ 😀😀 ok", "caf t ok",
     [3, 2.0, 0.222222, 0, 0, 0, 0, 0, 14, 0, 3, 0, 3, 1, -2.62, 0, 0, 0]),
    ("12 34 56", "12 34 56", [3, 2.0, 0, 0, 0, 0, 0, 0, 8, 0, 3, 0, 2, 2, -10.486667, 0, 0, 0]),
    ("you and they hate us, you IDIOT idiot!", "you and they hate us you idiot idiot",
     [8, 3.625, 0.172414, 0.026316, 0, 0, 1, 0, 38, 0, 6, 2, 5, 2, 2.28, 0.125, 0.125, 0.25]),
    ("The table made.", "the table made",
     [3, 4.0, 0.083333, 0, 0, 0.066667, 1, 0, 15, 0, 3, 0, 5, 3, -2.62, 0, 0, 0]),
    ("\n\n\n x", "x", [1, 1.0, 0, 0, 0, 0, 0, 0, 5, 0, 1, 0, 1, 1, -3.4, 0, 0, 0]),
]


@pytest.fixture(scope="module")
def features(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "id int, text string")
    out = tx.lexical_features(df).withColumns(tx.pronoun_columns(F.col("tokens")))
    return {r["id"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(ROWS)))
def test_edge_rows(features, i):
    _, clean, expected = ROWS[i]
    row = features[i]
    assert row["clean"] == clean
    got = [round(float(row[n]), 6) for n in NAMES]
    assert got == pytest.approx([float(v) for v in expected], abs=1e-6)


@pytest.mark.parametrize(
    "raw, clean, repeats",
    [
        ("www.foo.com\xa0bar", "bar", 1),  # the three w
        ("x   y", "x y", 1),
        ("\r\r\r\r", "", 1),
        (None, "", 0),
    ],
)
def test_clean_edges(spark, raw, clean, repeats):
    df = spark.createDataFrame([(raw,)], "text string")
    row = tx.lexical_features(df).first()
    assert row["clean"] == clean
    assert row["repeated_chars"] == repeats


def test_uppercase_can_exceed_alphabetic(spark):
    row = tx.lexical_features(spark.createDataFrame([("ⅠⒶ A",)], "text string")).first()
    assert row["uppercase_ratio"] == 3.0


def test_syllables_word_and_text_agree(spark):
    words = ["", "the", "table", "made", "eye", "queue", "rhythm", "tsk", "a1b", "ebe", "be",
             "banana", "12", "hmm1", "see3e", "apple", "idea", "ate"]
    df = spark.createDataFrame([(" ".join(w for w in words if w),)], "clean string")
    total = df.select(tx.syllable_total(F.col("clean"))).first()[0]
    each = spark.createDataFrame([(w,) for w in words], "w string").select(
        F.sum(tx.syllables(F.col("w")))
    )
    assert total == each.first()[0]


def plain_syllables(word):
    word = "".join(c for c in word if "a" <= c <= "z")
    flags = [c in "aeiouy" for c in word]
    groups = sum(f and not p for f, p in zip(flags, [False, *flags]))
    if word.endswith("e") and groups > 1:
        groups -= 1
    return max(groups, 1) if word else 0


def test_syllables_property(spark):
    import random

    rng = random.Random(7)
    texts = [
        " ".join("".join(rng.choice("aeioybcd1e") for _ in range(rng.randint(1, 7))) for _ in range(9))
        for _ in range(200)
    ]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select(
        "c", tx.syllable_total(F.col("c")).alias("n")
    )
    for row in got.collect():
        assert row["n"] == sum(plain_syllables(w) for w in row["c"].split())


def test_ngrams_and_counts(spark):
    df = spark.createDataFrame(
        [(["a", "red", "cat", "sat"],), (["red", "cat", "red", "cat"],), (["a"],), ([],), (["dog"],)],
        "tokens array<string>",
    )
    grams = [r[0] for r in df.select(tx.ngrams(F.col("tokens"))).collect()]
    assert grams == [
        ["red", "cat", "sat", "red cat", "cat sat"],
        ["red", "cat", "red", "cat", "red cat", "cat red", "red cat"],
        [], [], ["dog"],
    ]
    flags = df.select(F.explode(tx.flagged_terms(tx.ngrams(F.col("tokens")))).alias("t")).select("t.*")
    stats = flags.groupBy("term").agg(F.count("*").alias("n"), F.sum("first").alias("df"))
    assert {r["term"]: (r["n"], r["df"]) for r in stats.collect()} == {
        "red": (3, 2), "cat": (3, 2), "sat": (1, 1), "red cat": (3, 2), "cat sat": (1, 1),
        "cat red": (1, 1), "dog": (1, 1),
    }


def test_count_in(spark):
    df = spark.createDataFrame([(["x", "y", "x"],), ([],)], "tokens array<string>")
    got = [r[0] for r in df.select(tx.count_in(F.col("tokens"), ["x", "z"])).collect()]
    assert got == [2, 0]


def test_syllables_are_counted_without_a_list_of_matches(spark):
    df = spark.createDataFrame([("the cake",)], "c string").select(tx.syllable_total(F.col("c")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "ArrowEvalPython" in plan


def test_syllable_counts_of_odd_texts():
    words = ["", "7", "2e2", "brr", "cake", "ae", "the", "queue", "e", "a1e", "x y", "sate b", "be", "aebe", "1a2te3"]
    texts = pa.array(["x "] + [w + " " for w in words])
    def plain(word):
        letters = "".join(c for c in word if not c.isdigit())
        groups = len(re.findall("[aeiouy]+", letters))
        return max(1, groups - (letters.endswith("e") and groups > 1)) if letters else 0

    want = [sum(plain(x) for x in w.split()) for w in words]
    assert tx.syllable_counts(texts.slice(1)).tolist() == want
    assert tx.syllable_counts(texts.slice(0, 0)).tolist() == []
