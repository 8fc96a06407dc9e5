import math

import pytest
from pyspark.sql import functions as F

from corpuslens.operators.tfidf import (
    TfidfEstimator,
    early_limit,
    term_statistics,
    top_per_group,
    vocabulary,
)

CORPUS = [("m", 0, "a red cat sat"), ("m", 1, "red cat red cat"), ("m", 2, "dog sat")]
# doc, term, df, idf, weight
GOLDEN = [
    (0, "cat", 2, 1.287682, 0.417796), (0, "cat sat", 1, 1.693147, 0.549351),
    (0, "red", 2, 1.287682, 0.417796), (0, "red cat", 2, 1.287682, 0.417796),
    (0, "sat", 2, 1.287682, 0.417796), (1, "cat", 2, 1.287682, 0.52682),
    (1, "cat red", 1, 1.693147, 0.409123), (1, "red", 2, 1.287682, 0.52682),
    (1, "red cat", 2, 1.287682, 0.52682), (2, "dog", 1, 1.693147, 0.622766),
    (2, "dog sat", 1, 1.693147, 0.622766), (2, "sat", 2, 1.287682, 0.47363),
]
SCHEMA = "dataset string, id int, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, SCHEMA)


def test_micro_corpus(corpus):
    model = TfidfEstimator().fit(corpus)
    weights = {(r["id"], r["term"]): r["weight"] for r in model.transform(corpus).collect()}
    assert weights == {(d, t): pytest.approx(w, abs=1e-6) for d, t, _, _, w in GOLDEN}
    state = {r["term"]: (r["df"], r["idf"]) for r in model.state.collect()}
    assert state == {t: (df, pytest.approx(idf, abs=1e-6)) for _, t, df, idf, _ in GOLDEN}


def test_cap_breaks_ties_by_term(corpus):
    model = TfidfEstimator(max_features=5).fit(corpus)
    # cat, red and red cat occur three times, sat twice, the rest once.
    rows = model.state.orderBy("rank").collect()
    assert [r["term"] for r in rows] == ["cat", "red", "red cat", "sat", "cat red"]
    assert [r["index"] for r in rows] == [0, 2, 3, 4, 1]


def test_unseen_rows(spark, corpus):
    model = TfidfEstimator().fit(corpus)
    new = spark.createDataFrame(
        [("m", 9, "red RED fish"), ("m", 10, "nothing known"), ("m", 11, None), ("other", 12, "red")], SCHEMA
    )
    rows = [tuple(r) for r in model.transform(new).collect()]
    assert rows == [("m", 9, "red", pytest.approx(1.0))]


def test_groups_are_independent(spark):
    rows = spark.createDataFrame([("a", 1, "xx yy"), ("b", 2, "xx"), ("b", 3, "zz zz")], SCHEMA)
    state = TfidfEstimator().fit(rows).state
    got = {(r["dataset"], r["term"]): (r["total"], r["df"], r["n_rows"]) for r in state.collect()}
    assert got == {
        ("a", "xx"): (1, 1, 1), ("a", "yy"): (1, 1, 1), ("a", "xx yy"): (1, 1, 1),
        ("b", "xx"): (1, 1, 2), ("b", "zz"): (2, 1, 2), ("b", "zz zz"): (1, 1, 2),
    }


def test_sparse_equals_long(corpus):
    model = TfidfEstimator().fit(corpus)
    place = {r["term"]: r["index"] for r in model.state.collect()}
    long = {(r["id"], place[r["term"]]): r["weight"] for r in model.transform(corpus).collect()}
    cells = {}
    for row in model.transform_sparse(corpus).collect():
        v = row["tfidf"]
        assert v["size"] == len(place) and v["indices"] == sorted(v["indices"])
        assert math.isclose(sum(x * x for x in v["values"]), 1.0)
        cells |= {(row["id"], i): x for i, x in zip(v["indices"], v["values"])}
    assert cells == {k: pytest.approx(w) for k, w in long.items()}


def test_transform_has_one_exchange(corpus):
    plan = TfidfEstimator().fit(corpus).transform(corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ranked_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    with early_limit(spark, 5000):
        top = top_per_group(df, "g", [F.desc("v")], 5000)
        plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert [r["v"] for r in top.filter("g = 0 and rank <= 2").orderBy("rank").collect()] == [19_998, 19_996]
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == "1000"


def test_vocabulary_is_cut_before_the_shuffle(spark, corpus):
    with early_limit(spark, 10_000):
        terms = vocabulary(term_statistics(corpus), "dataset", 10_000)
        plan = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
