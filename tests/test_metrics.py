import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import metrics as mx
from corpuslens.operators import reports as rp

FOLD_COUNTS = [(32, 140, 20, 8)]
SCORED = "key string, label int, prediction int, score double"


def brute_auc(pairs):
    pos = [s for l, s in pairs if l == 1]
    neg = [s for l, s in pairs if l == 0]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = []
    for key, n, levels in (("hot", 400, 1000), ("ties", 150, 5), ("small", 12, 1000)):
        for _ in range(n):
            label = int(rng.random() < 0.3)
            score = rng.randrange(levels) / levels + label * 0.1
            rows.append((key, label, int(score > 0.6), score))
    rows += [("one", 1, 1, 0.4), ("one", 1, 0, 0.3)]
    return spark.createDataFrame(rows, SCORED), rows


def expected_auc(rows):
    keys = {r[0] for r in rows}
    return {k: brute_auc([(l, s) for key, l, _, s in rows if key == k]) for k in keys - {"one"}}


@pytest.mark.parametrize("small", [100_000, 0])
def test_auc_equals_brute_force(scored, small):
    df, rows = scored
    got = {r["key"]: r["roc_auc"] for r in mx.roc_auc(df, ["key"], small=small).collect()}
    assert got.pop("one") == 0.0
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in expected_auc(rows).items()}


def test_auc_of_one_class_may_be_null(scored):
    df, _ = scored
    got = mx.roc_auc(df.filter("key = 'one'"), ["key"], one_class=None).first()
    assert got["roc_auc"] is None


def test_auc_invariant_under_monotone_map(scored):
    df, rows = scored
    moved = df.withColumn("score", F.col("score") * 8)
    got = {r["key"]: r["roc_auc"] for r in mx.roc_auc(moved, ["key"]).collect()}
    for key, value in expected_auc(rows).items():
        assert got[key] == pytest.approx(value, abs=1e-12)


def test_published_fold_row(spark):
    counts = spark.createDataFrame(
        [(32, 140, 20, 8)],
        "true_positives long, true_negatives long, false_positives long, false_negatives long",
    )
    row = mx.with_metrics(counts).first()
    assert row["accuracy"] == pytest.approx(0.86)
    assert row["precision"] == pytest.approx(0.6153846153846154)
    assert row["recall"] == pytest.approx(0.8)
    assert row["f1"] == pytest.approx(0.6956521739130435)


def test_fold_summary_uses_population_deviation(spark):
    values = [0.5, 0.7, 0.6, 0.9, 0.8]
    rows = [("d", i + 1, v, v, v, v, None if i == 0 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(
        rows, "dataset string, fold int, f1 double, accuracy double, precision double, recall double, roc_auc double"
    )
    row = mx.fold_summary(df, ["dataset"], with_rows=True).first()
    assert row["n_folds"] == 5 and row["f1_mean"] == pytest.approx(0.7)
    assert row["f1_std"] == pytest.approx(0.02**0.5)
    assert row["roc_auc_mean"] == pytest.approx(0.75)
    assert [r["fold"] for r in row["fold_metrics"]] == [1, 2, 3, 4, 5]


def test_empty_denominators(spark):
    df = spark.createDataFrame([("k", 0, 0, 0.1), ("k", 0, 0, 0.2)], SCORED)
    row = mx.evaluate(df, ["key"]).first()
    assert (row["precision"], row["recall"], row["f1"], row["roc_auc"]) == (0, 0, 0, 0)
    assert (row["true_negatives"], row["accuracy"]) == (2, 1.0)


def test_classification_report(spark):
    rows = [("k", 1, 1, 0.0)] * 3 + [("k", 1, 0, 0.0)] + [("k", 0, 0, 0.0)] * 5 + [("k", 0, 1, 0.0)]
    report = {r["class"]: r for r in mx.classification_report(spark.createDataFrame(rows, SCORED), ["key"]).collect()}
    assert report["1"]["precision"] == 0.75 and report["1"]["recall"] == 0.75
    assert report["0"]["precision"] == pytest.approx(5 / 6) and report["0"]["support"] == 6
    assert report["macro avg"]["precision"] == pytest.approx((0.75 + 5 / 6) / 2)
    assert report["weighted avg"]["precision"] == pytest.approx((0.75 * 4 + 5) / 10)
    assert report["accuracy"]["f1"] == 0.8 and report["accuracy"]["support"] == 10


RESULTS = [
    ("reddit", "A_FULL", 0.5869565217391304), ("reddit", "G_NO_TFIDF", 0.5714285714285714),
    ("reddit", "H_NO_LEXICAL", 0.6896551724137931), ("reddit", "I_NO_HATE_LEXICON", 0.5192307692307693),
    ("reddit", "J_NO_SENTIMENT", 0.6046511627906976), ("reddit", "K_NO_EMBEDDING", 0.5869565217391304),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(RESULTS + [("4chan", "A_FULL", 0.65)], "dataset string, experiment string, f1 double")


def test_delta_f1(results):
    got = {r["feature_group"]: r["delta_f1"] for r in rp.delta_f1(results).collect()}
    assert got["TF-IDF"] == pytest.approx(0.015527950310558869)
    assert got["Lexical"] == pytest.approx(-0.10269865067466277)
    assert got["Hate Lexicon"] == pytest.approx(0.0677257525083611)
    assert got["Sentiment"] == pytest.approx(-0.01769464105156726)
    assert got["Embedding"] == 0.0


def test_ranking(results):
    rows = rp.group_ranking(rp.delta_f1(results)).orderBy("rank").collect()
    assert [r["feature_group"] for r in rows] == ["Hate Lexicon", "TF-IDF", "Embedding", "Sentiment", "Lexical"]


def test_grid_and_pivot(results):
    grid = {(r["dataset"], r["experiment_clean"]): r["f1"] for r in rp.dense_grid(results).collect()}
    assert len(grid) == 12 and grid[("4chan", "G NO TFIDF")] == 0.0
    pivot = {r["experiment"]: (r["4chan"], r["reddit"]) for r in rp.f1_pivot(results).collect()}
    assert pivot["A_FULL"] == (0.65, 0.5869565217391304) and pivot["G_NO_TFIDF"][0] is None


def test_grid_has_no_cross_join(results):
    plan = rp.dense_grid(results)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# Published F1 of the transfer table and the drops that belong to them.
TRANSFER = [
    ("reddit", "reddit", 0.6945282832647169, 0.0), ("reddit", "4chan", 0.7669, -10.4),
    ("reddit", "twitter", 0.7955, -14.5),
]


def test_f1_drop(spark):
    df = spark.createDataFrame([r[:3] for r in TRANSFER], "train_dataset string, test_dataset string, f1 double")
    drops = rp.f1_drop(df)
    got = {r["test_dataset"]: round(r["f1_drop_pct"], 1) for r in drops.collect()}
    assert got == {t: d for _, t, _, d in TRANSFER}
    wide = rp.cross_pivot(drops, ["reddit", "4chan"]).first()
    assert wide["reddit_f1_drop_pct"] == 0.0 and wide["4chan_f1"] == 0.7669
    nested = rp.nested_transfer(drops).first()["by_test_dataset"]
    assert nested["4chan"]["f1"] == 0.7669 and len(nested) == 3


def test_cv_summary(spark):
    row = ("reddit", 0.69452828, 0.06158224, 0.864, 0.0269, 0.63, 0.05, 0.775, 0.08)
    df = spark.createDataFrame(
        [row],
        "dataset string, f1_mean double, f1_std double, accuracy_mean double, accuracy_std double, "
        "precision_mean double, precision_std double, recall_mean double, recall_std double",
    )
    got = rp.cv_summary(df).first()
    assert got["Dataset"] == "Reddit" and got["F1 (mean ± std)"] == "0.6945 ± 0.0616"
