import pytest
from pyspark.sql import functions as F

from corpuslens.functions.text import with_tokens
from corpuslens.operators import dictionaries as dc
from corpuslens.operators.lexicon import build_lexicon

TEXTS = [
    (1, "You idiot, IDIOT! total scum"),
    (2, "a fine day"),
    (3, ""),
    (4, None),
    (5, "good good bad"),
    (6, "nice nice nice"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return with_tokens(spark.createDataFrame(TEXTS, "id int, text string"))


@pytest.mark.parametrize("bound", [10_000, 0])
def test_lexicon_features(spark, rows, bound):
    terms = spark.createDataFrame([("idiot",), ("scum",), ("total scum",), ("idiot",)], "term string")
    got = dc.lexicon_features(rows, terms, inline_terms=bound)
    values = {r["id"]: (r["hate_word_count"], r["hate_word_ratio"], r["contains_hate_word"]) for r in got.collect()}
    assert values == {1: (3, 0.6, 1), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (0, 0, 0)}


def test_small_lexicon_needs_no_shuffle(spark, rows):
    terms = spark.createDataFrame([("idiot",)], "term string")
    plan = dc.lexicon_features(rows, terms)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("bounds", [(10_000, 128), (10_000, 0), (0, 0)])
def test_sentiment(spark, rows, bounds):
    words = spark.createDataFrame(
        [("idiot", -0.8, 0.8), ("scum", -0.7, 0.9), ("good", 0.7, 0.6), ("bad", -0.7, 0.2), ("nice", 0.1, 0.3)],
        "word string, polarity double, subjectivity double",
    )
    got = {r["id"]: r for r in dc.sentiment_features(rows, words, *bounds).collect()}
    assert len(got) == 6
    assert got[1]["sentiment_polarity"] == pytest.approx(-2.3 / 3)
    assert got[1]["sentiment_subjectivity"] == pytest.approx(2.5 / 3)
    assert (got[1]["sentiment_very_negative"], got[1]["highly_subjective"]) == (1, 1)
    assert got[3]["sentiment_polarity"] == 0.0 and got[3]["sentiment_neutral"] == 1
    assert got[4]["highly_objective"] == 1
    assert got[5]["sentiment_polarity"] == pytest.approx(0.7 / 3)
    assert got[5]["sentiment_positive"] == 1
    # A mean of exactly 0.1 is neutral, whatever the order of summation.
    assert (got[6]["sentiment_neutral"], got[6]["sentiment_positive"]) == (1, 0)


@pytest.mark.parametrize("bound", [10_000, 0])
def test_token_classes(spark, rows, bound):
    words = spark.createDataFrame(
        [("idiot", "NOUN"), ("scum", "NOUN"), ("total", "ADJ"), ("fine", "ADJ"), ("you", "PRON")],
        "word string, class string",
    )
    got = dc.token_class_ratios(rows, words, inline_terms=bound)
    values = {r["id"]: (r["noun_ratio"], r["verb_ratio"], r["adj_ratio"]) for r in got.collect()}
    assert values[1] == (0.6, 0.0, 0.2)
    assert values[2] == pytest.approx((0, 0, 1 / 3))
    assert values[3] == values[4] == (0, 0, 0)


@pytest.mark.parametrize("bounds", [(10_000, 128), (0, 0)])
def test_both_paths_mean_the_same(spark, rows, bounds):
    """Rows that repeat, null entries: one answer, whatever the size of the dictionary."""
    twice = rows.unionByName(rows)
    terms = spark.createDataFrame([("idiot",), (None,), ("scum",)], "term string")
    got = dc.lexicon_features(twice, terms, inline_terms=bounds[0]).filter("id = 1").collect()
    assert [(r["hate_word_count"], r["hate_word_ratio"]) for r in got] == [(3, 0.6)] * 2
    words = spark.createDataFrame(
        [("good", 0.5, 0.5), ("bad", None, 0.5), (None, 1.0, 1.0)], "word string, polarity double, subjectivity double"
    )
    got = dc.sentiment_features(twice, words, *bounds).filter("id = 5").collect()
    assert [(r["sentiment_polarity"], r["sentiment_subjectivity"]) for r in got] == [(0.5, 0.5)] * 2


def test_words_listed_twice_are_refused(spark, rows):
    words = spark.createDataFrame([("a", 0.1, 0.1), ("a", 0.2, 0.1)], "word string, polarity double, subjectivity double")
    with pytest.raises(ValueError, match="'a'"):
        dc.sentiment_features(rows, words)
    with pytest.raises(ValueError, match="'b'"):
        dc.token_class_ratios(rows, spark.createDataFrame([("b", "NOUN"), ("b", "VERB")], "word string, class string"))


def test_empty_dictionaries(spark, rows):
    none = spark.createDataFrame([], "word string, polarity double, subjectivity double")
    assert dc.sentiment_features(rows, none).agg(F.max("sentiment_magnitude")).first()[0] == 0.0


def test_lexicon_build(spark):
    base = spark.createDataFrame([("Dog",), ("cats",), ("ox",), ("x y",), ("dog",)], "term string")
    variants = spark.createDataFrame([("dog", ["d0g", "dawg"]), ("x", ["hé", "élan"])], "base string, variants array<string>")
    got = sorted(r["term"] for r in build_lexicon(base, variants).collect())
    assert got == ["cats", "dawg", "dog", "dogs", "oxs", "x y", "x ys", "élan"]


def test_words_are_shuffled_with_a_short_key_of_their_list(spark, rows, monkeypatch):
    seen = []
    real = type(rows).dropDuplicates
    monkeypatch.setattr(type(rows), "dropDuplicates", lambda df, names=None: seen.append(df) or real(df, names))
    words = spark.createDataFrame([("idiot", "NOUN")], "word string, class string")
    dc.token_class_ratios(rows, words, inline_terms=0).collect()
    assert {len(r["_list"]) for df in seen if "_list" in df.columns for r in df.collect()} == {16}
