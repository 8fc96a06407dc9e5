import hashlib

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import splits as sp


@pytest.fixture(scope="module")
def rows(spark):
    # One class holds most of the rows.
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("dataset"),
        "id",
        (F.col("id") % 7 == 0).cast("int").alias("label"),
    )


def naive_rank(rows, seed=42):
    classes = {}
    for r in rows.collect():
        draw = hashlib.md5(f"{seed}|{r['id']}".encode()).hexdigest()
        classes.setdefault((r["dataset"], r["label"]), []).append((draw, r["id"]))
    return {i: (n, len(m)) for m in classes.values() for n, (_, i) in enumerate(sorted(m), 1)}


def test_rank_equals_whole_class_sort(rows):
    ranked = sp.rank_in_class(rows, ["dataset", "label"], 42)
    assert {r["id"]: (r["class_rank"], r["class_size"]) for r in ranked.collect()} == naive_rank(rows)


def test_no_task_sorts_a_whole_class(rows):
    plan = sp.rank_in_class(rows, ["dataset", "label"], 42)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dataset" in plan and "_share" in plan.split("hashpartitioning(dataset")[1][:60]


def test_folds_are_even(rows):
    sizes = sp.stratified_folds(rows).groupBy("dataset", "label", "fold").count().collect()
    per_class = {}
    for r in sizes:
        per_class.setdefault((r["dataset"], r["label"]), []).append(r["count"])
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in per_class.values())


def test_hash_folds(rows):
    folds = sp.stratified_folds(rows, mode="hash")
    assert sorted(r["fold"] for r in folds.select("fold").distinct().collect()) == [1, 2, 3, 4, 5]
    assert "Exchange" not in folds._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sp.stratified_folds(rows, mode="other")


def test_holdout(rows):
    got = sp.stratified_holdout(rows).groupBy("dataset", "label").agg(
        F.sum("is_test").alias("t"), F.count("*").alias("n")
    )
    for r in got.collect():
        assert r["t"] == round(0.2 * r["n"])


def test_class_guard(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1)], "dataset string, label int")
    assert {r["dataset"] for r in sp.class_guard(rows).collect()} == {"a"}


def test_class_weights(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("a", 0), ("a", 1)], "dataset string, label int")
    got = {r["label"]: r["weight"] for r in sp.with_class_weights(rows).collect()}
    assert got == {0: pytest.approx(4 / 6), 1: 2.0}
