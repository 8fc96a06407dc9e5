import math
from collections import Counter

import pyarrow as pa
import pytest

from corpuslens.operators import terms as tm
from corpuslens.operators.tfidf import TfidfEstimator, term_statistics

# Repeated keys, null keys, a null and an empty text, one-letter words, a text with its words twice.
ROWS = [
    ("m", 1, "Red cat, a red cat"), ("m", 1, "cat sat"), ("m", None, "red"), ("m", None, "a b sat"), (None, 2, "red cat"),
    ("k", 2, None), ("k", 3, ""), ("k", 4, "x"), ("k", 5, "red cat red cat dog"), ("k", 6, "dog dog"),
]
SCHEMA = "dataset string, id int, text string"


def grams(text):
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if len(w) > 1]
    return words + [" ".join(p) for p in zip(words, words[1:])]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_statistics_count_every_occurrence(rows, monkeypatch):
    total, df = Counter(), Counter()
    for group, _, text in ROWS:
        total.update((group, t) for t in grams(text))
        df.update((group, t) for t in set(grams(text)))
    found = {(r["dataset"], r["term"]): (r["total"], r["df"]) for r in term_statistics(rows).collect()}
    assert found == {key: (n, df[key]) for key, n in total.items()}


def test_occurrences_are_counted_before_spark_groups_them(rows):
    plan = term_statistics(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("words", [1, 3, 1 << 20])
def test_slices_give_the_same_counts(words, monkeypatch):
    monkeypatch.setattr(tm, "WORDS", words)
    texts = ["red cat red cat", "cat", "", "a red cat"]
    batch = pa.RecordBatch.from_pydict({"group": ["g"] * 4, "clean": texts})
    total, df = Counter(), Counter()
    for part in tm.count_terms(iter([batch])):
        for r in part.to_pylist():
            total[r["term"]] += r["total"]
            df[r["term"]] += r["df"]
    assert total == {"red": 3, "cat": 4, "red cat": 3, "cat red": 1}
    assert df == {"red": 2, "cat": 3, "red cat": 2, "cat red": 1}


def expected(state):
    """Rows of one key are one text; a null dataset has no vocabulary."""
    tf = {}
    for group, key, text in ROWS:
        if group is not None:
            tf.setdefault((group, key), Counter()).update(grams(text))
    idf = {(r["dataset"], r["term"]): r["idf"] for r in state}
    cells = {}
    for (group, key), counts in tf.items():
        own = {t: (1 + math.log(n)) * idf[group, t] for t, n in counts.items() if (group, t) in idf}
        length = math.sqrt(sum(w * w for w in own.values()))
        cells.update({(group, key, t): pytest.approx(w / length) for t, w in own.items()})
    return cells


def test_weights_of_repeated_and_null_keys(rows):
    model = TfidfEstimator(max_features=6).fit(rows)
    want = expected(model.state.collect())
    found = [tuple(r) for r in model.transform(rows).collect()]
    assert {(g, k, t): w for g, k, t, w in found} == want and len(found) == len(want)
    index = {(r["dataset"], r["index"]): r["term"] for r in model.state.collect()}
    cells = {}
    for r in model.transform_sparse(rows).collect():
        places = r["tfidf"]["indices"]
        assert places == sorted(places) and r["tfidf"]["size"] == model.sizes()[r["dataset"]]
        cells.update({(r["dataset"], r["id"], index[r["dataset"], i]): w for i, w in zip(places, r["tfidf"]["values"])})
    assert cells == want


def test_one_row_per_key_and_no_join(rows):
    model = TfidfEstimator().fit(rows)
    plan = model.transform_sparse(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


def test_a_vocabulary_beyond_the_bound_gives_the_same(rows, monkeypatch):
    model = TfidfEstimator().fit(rows)
    small = {tuple(r)[:3]: pytest.approx(r["weight"]) for r in model.transform(rows).collect()}
    monkeypatch.setattr("corpuslens.operators.tfidf.small_table", lambda df: None)
    assert {tuple(r)[:3]: r["weight"] for r in model.transform(rows).collect()} == small


def test_a_key_cut_by_batches_is_one_text():
    table = pa.table({"group": ["g", "g"], "term": ["cat", "red"], "index": pa.array([0, 1], pa.int32()), "idf": [1.0, 2.0]})
    batches = [
        pa.RecordBatch.from_pydict({"group": ["g"] * len(keys), "key": keys, "clean": texts})
        for keys, texts in [([1, 2], ["cat", "red"]), ([2], ["red cat"]), ([2, 3], ["red", "none here"])]
    ]
    rows = [r for found in tm.weigh_terms(table)(iter(batches)) for r in found.to_pylist()]
    length = math.hypot(1.0, 2 * (1 + math.log(3)))
    assert [(r["key"], r["terms"], r["indices"]) for r in rows] == [(1, ["cat"], [0]), (2, ["cat", "red"], [0, 1])]
    assert rows[1]["weights"] == pytest.approx([1 / length, 2 * (1 + math.log(3)) / length])
