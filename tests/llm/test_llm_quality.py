import numpy as np
import pytest

from corpuslens.llm import quality as q


def test_statistics_of_odd_texts():
    for text in ("", " \n", "a", "a" * 300_000, "é漢😀", "A!! A!! A!!\nB"):
        stats = q.statistics(text)
        assert len(stats) == len(q.NAMES) and np.isfinite(stats).all()
    by_name = dict(zip(q.NAMES, q.statistics("AB ab ab 1!")))
    assert by_name["repeats"] == 1 / 4 and by_name["shouted"] == 1 / 4 and by_name["digits"] == 1 / 11


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(0).standard_normal((40, len(q.NAMES)))
    z = q.fourier(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2 / len(q.NAMES))
    assert np.abs(z @ z.T - kernel).mean() < 0.06


def test_isotonic_equals_least_squares_over_rising_values():
    x, good, total = np.arange(6.0), np.array([1.0, 0, 2, 1, 3, 2]), np.array([2.0, 2, 2, 2, 3, 2])
    steps, values = q.isotonic(x, good, total)
    assert (np.diff(values) > 0).all() and (np.diff(steps) > 0).all()
    assert values.tolist() == [0.25, 0.75, 1.0]


def frame(spark, n=300):
    rows = [(i, ("ba de lo mi ta " * 20 if i % 4 else "JUNK!! ### " * 30) + f"w{i} " * (i % 7), "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, stats string"), spark.createDataFrame(
        [(i, int(i % 4 > 0)) for i in range(n)], "doc_id long, label int"
    )


def test_unseen_documents(spark):
    docs, labels = frame(spark)
    stats = q.with_statistics(docs)
    model = q.fit(stats, labels.where("doc_id % 3 <> 1"))
    out = q.score(stats, model).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 4 > 0) for r in out) and all(0 <= r.score <= 1 for r in out)


def test_sums_do_not_depend_on_partitions(spark):
    docs, labels = frame(spark)
    stats = q.with_statistics(docs)
    one, many = (q.fit(stats.repartition(n), labels) for n in (1, 7))
    assert np.allclose(one.weights, many.weights, atol=1e-8)


@pytest.mark.parametrize("kept, score", [("false", 0.0), ("label = 1", 1.0), ("label = 0", 0.0)])
def test_without_both_labels(spark, kept, score):
    docs, labels = frame(spark, 12)
    stats = q.with_statistics(docs)
    assert {r.score for r in q.score(stats, q.fit(stats, labels.where(kept))).collect()} == {score}


def test_edge_rows(spark):
    docs, labels = frame(spark)
    model = q.fit(q.with_statistics(docs), labels)
    rows = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (4, "x" * 200_000)]
    out = q.score(q.with_statistics(spark.createDataFrame(rows, "doc_id long, text string")), model).collect()
    assert out[0].score == out[1].score and out[2] == out[3] and len(out) == 5
    empty = q.with_statistics(docs.limit(0))
    assert q.score(empty, q.fit(empty, labels)).count() == 0


def test_query_on_held_out_rows(spark):
    from corpuslens.llm.queries import op8_quality

    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = op8_quality(spark, path).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
