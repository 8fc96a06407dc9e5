from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors as MLVectors
from pyspark.sql import functions as F

from catalog import inputs as src
from corpuslens.operators.align import align_columns, align_terms
from corpuslens.operators.classify import convergence, fit_logistic, score
from corpuslens.operators import many_models as mm
from corpuslens.operators import selection
from corpuslens.operators.selection import forest_importances, select_terms
from corpuslens.plans import ablation as ab
from corpuslens.plans import features as ft
from corpuslens.plans import regimes as rg
from corpuslens.plans.saved import load_model, save_model
from corpuslens.session import written
from corpuslens.sources import writers as wr

TINY = ft.Settings(max_tfidf_features=300, tfidf_n_selected=40, trees=5, depth=3)


@pytest.fixture(scope="module")
def posts(spark, sf_small):
    return written(src.posts(spark, sf_small), "test-posts")


@pytest.fixture(scope="module")
def extractor(spark, sf_small):
    return ft.FeatureExtractor(src.dictionaries(spark), src.vectors(spark, sf_small), TINY)


@pytest.fixture(scope="module")
def model(extractor, posts):
    return extractor.fit(posts)


def test_feature_groups():
    names = [*ft.LEXICAL_GROUP, *ft.LEXICON_GROUP, *ft.SENTIMENT_GROUP, *ft.RATIO_COLUMNS,
             *ft.EMBEDDING_SCORES, "embed_0", "tfidf_red cat", "label", "unknown"]
    groups = ft.identify_feature_groups(names)
    assert {k: len(v) for k, v in groups.items()} == {
        "lexical": 15, "hate_lexicon": 3, "sentiment": 10, "embedding": 10, "tfidf": 1,
    }


def test_selection_size_is_min_k_p(model):
    sizes = {r["dataset"]: r["count"] for r in model.selected.groupBy("dataset").count().collect()}
    assert sizes == {"p0": 40, "p1": 40, "p2": 40}
    assert len(model.terms) <= 120
    ranks = model.selected.filter("dataset = 'p0'").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 41))
    assert all(a["importance"] >= b["importance"] for a, b in zip(ranks, ranks[1:]))


def test_transform_covers_every_row_and_selected_cells_only(model, posts):
    rows = model.transform(posts)
    assert rows.count() == posts.count()
    weights = {(r["dataset"], r["id"], r["term"]): r["weight"] for r in model.tfidf.transform(posts).collect()}
    kept = {(r["dataset"], r["term"]) for r in model.selected.collect()}
    cells = {
        (r["dataset"], r["id"], model.terms[i]): v
        for r in rows.collect()
        for i, v in zip(r["tfidf"]["indices"], r["tfidf"]["values"])
    }
    assert cells == {k: pytest.approx(v) for k, v in weights.items() if (k[0], k[2]) in kept}


def test_store_is_read_as_vectors(model, posts):
    store = model.store(posts, "dataset")
    row = ft.assemble(store).first()
    width = 15 + 3 + 10 + 8 + 64 + len(model.terms)
    assert row["features"].size == width
    sizes = model.group_sizes("p0")
    assert sum(sizes.values()) == 15 + 3 + 10 + 8 + 64 + 40


def test_extract_features_needs_no_labels(model, extractor, posts):
    rows = ft.extract_features(posts.drop("label"), extractor, model)
    assert "label" not in rows.columns and rows.count() == posts.count()


def test_a_saved_model_transforms_as_before(spark, sf_small, model, extractor, posts, tmp_path):
    path = str(tmp_path / "model")
    save_model(model, path)
    session = spark.newSession()
    again = load_model(session, path, src.dictionaries(session), src.vectors(session, sf_small))
    rows = session.createDataFrame(posts.toArrow())
    key = lambda r: (r["dataset"], r["id"])
    assert sorted(again.transform(rows).collect(), key=key) == sorted(model.transform(posts).collect(), key=key)
    assert again.terms == model.terms and again.group_sizes("p0") == model.group_sizes("p0")
    with pytest.raises(Exception, match="(?i)exist"):
        save_model(model, path)
    with pytest.raises(ValueError, match="vectors"):
        load_model(spark, path, extractor.dictionaries, replace(extractor.vectors, size=3))
    model.neutral.withColumn("more", F.lit(1)).write.mode("overwrite").parquet(f"{path}/neutral")
    with pytest.raises(ValueError, match="neutral"):
        load_model(spark, path, extractor.dictionaries, extractor.vectors)


def test_fit_requires_columns(extractor, posts):
    with pytest.raises(ValueError, match="label"):
        extractor.fit(posts.drop("label"))


def test_selection_can_be_switched_off(spark, extractor, posts):
    loose = replace(extractor, settings=replace(TINY, tfidf_selection_method="none"))
    model, rows = loose.fit_transform(posts)
    assert model.group_sizes("p1")["tfidf"] == 300 and rows.count() == posts.count()


def test_logistic_gradient_vanishes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4)) * [1.0, 0.5, 2.0, 1.0]
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=600) > 0.8).astype(int)
    train = spark.createDataFrame([(MLVectors.dense(a), int(b)) for a, b in zip(x, y)], ["features", "label"])
    model = fit_logistic(train, tolerance=1e-14)
    w, b = model.coefficients, model.intercept
    weight = np.where(y == 1, 600 / (2 * y.sum()), 600 / (2 * (600 - y.sum())))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + x.T @ (weight * (p - y))).max() < 1e-4
    assert abs((weight * (p - y)).sum()) < 1e-4
    out = score(model, train).first()
    assert out["prediction"] in (0, 1) and 0 <= out["score"] <= 1


def test_badly_scaled_columns_converge(spark, posts):
    from pyspark.ml.functions import array_to_vector

    rows = ft.row_features(posts, src.dictionaries(spark))
    columns = F.array(*[F.col(c).cast("double") for c in (*ft.LEXICAL_GROUP, *ft.SENTIMENT_GROUP)])
    train = rows.select("id", "label", array_to_vector(columns).alias("features"))
    model = fit_logistic(train)
    state = convergence(model)
    assert not state["limit_reached"] and 0 < state["iterations"] < 60 and state["gradient_norm"] < 1e-3
    data = train.collect()
    x, y = np.array([r["features"].toArray() for r in data]), np.array([r["label"] for r in data])
    w, b = brute_fit(x, y)
    assert objective(x, y, model.coefficients, model.intercept) <= objective(x, y, w, b) * (1 + 1e-7)


def balanced_weights(y):
    return np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))


def objective(x, y, w, b):
    z = x @ w + b
    return 0.5 * w @ w + (balanced_weights(y) * (np.logaddexp(0, z) - y * z)).sum()


def brute_fit(x, y):
    """Damped Newton steps with the whole Hessian."""
    design, c = np.column_stack([x, np.ones(len(x))]), balanced_weights(y)
    ridge, beta = np.diag([1.0] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(200):
        p = 0.5 * (1 + np.tanh(0.5 * design @ beta))
        gradient = design.T @ (c * (p - y)) + ridge @ beta
        step = np.linalg.solve(design.T @ ((c * p * (1 - p))[:, None] * design) + ridge, gradient)
        share = 1.0
        while share > 1e-9 and objective(x, y, *np.split(beta - share * step, [-1])) > objective(x, y, *np.split(beta, [-1])):
            share /= 2
        beta = beta - share * step
    return beta[:-1], beta[-1]


def test_many_fits_in_one_scan_equal_single_ones(spark):
    """Dense and sparse columns, masks and overlapping parts; sums also by executors."""
    rng = np.random.default_rng(4)
    n, wide = 400, 700
    dense = rng.normal(size=(n, 3)) * [1, 1000, 0.01]
    sparse = [{int(j): float(v) for j, v in zip(rng.choice(wide, 8, replace=False), rng.random(8))} for _ in range(n)]
    part = rng.integers(0, 4, n)
    label = (dense[:, 0] + [sum(v for j, v in s.items() if j < 100) for s in sparse] + rng.normal(size=n) > 0.7).astype(int)
    rows = [(i, int(part[i]), int(label[i]), MLVectors.dense(dense[i]), MLVectors.sparse(wide, sparse[i])) for i in range(n)]
    store = written(spark.createDataFrame(rows, ["id", "part", "label", "a", "b"]).repartition(20), "many")
    fits = [
        mm.ManyFit(frozenset([0, 1]), frozenset([2, 3])), mm.ManyFit(frozenset([1, 2, 3]), frozenset([0]), ("a",)),
        mm.ManyFit(frozenset([0, 1, 2, 3]), frozenset([1]), ("b",)),
    ]
    models = mm.fit_many(store, fits, ("a", "b"))
    whole = np.zeros((n, 3 + wide))
    whole[:, :3] = dense
    for i, s in enumerate(sparse):
        whole[i, [3 + j for j in s]] = list(s.values())
    margins = []
    for fit, model in zip(fits, models):
        own = np.array([k for k in range(3 + wide) if fit.vectors is None or ("a" if k < 3 else "b") in fit.vectors])
        used = np.isin(part, list(fit.train))
        w, b = brute_fit(whole[used][:, own], label[used])
        assert np.allclose(model.coefficients[own], w, atol=2e-3 * np.abs(w).max()) and not model.limit_reached
        assert np.allclose(np.delete(model.coefficients, own), 0)
        margins.append(whole @ model.coefficients + model.intercept)
    scored = mm.score_many(store, fits, models, ["id"]).collect()
    assert sorted((r["fit"], r["id"]) for r in scored) == sorted((f, i) for f, fit in enumerate(fits) for i in range(n) if part[i] in fit.test)
    assert all(r["score"] == pytest.approx(1 / (1 + np.exp(-margins[r["fit"]][r["id"]]))) and r["prediction"] == (r["score"] > mm.HALF) for r in scored)


def test_passes_read_blocks_not_the_store(spark, monkeypatch):
    """Rows are counted once and packed once, however many passes a fit takes; sums by executors are the same."""
    rng = np.random.default_rng(6)
    n, wide = 300, 600
    x = [{int(j): float(v) for j, v in zip(rng.choice(wide, 5, replace=False), rng.random(5))} for _ in range(n)]
    label = [int(sum(v for j, v in s.items() if j < 300) > 1.2) for s in x]
    rows = [(i % 3, label[i], MLVectors.dense(rng.normal(size=2)), MLVectors.sparse(wide, x[i])) for i in range(n)]
    store = written(spark.createDataFrame(rows, ["number", "label", "a", "b"]).repartition(5), "counted")
    seen = spark.sparkContext.accumulator(0)

    def counted(number):
        seen.add(1)
        return number

    numbered = store.withColumn("part", F.udf(counted, "int")("number"))
    fits = [mm.ManyFit(frozenset([0, 1])), mm.ManyFit(frozenset([1, 2]))]
    models = mm.fit_many(numbered, fits, ("a", "b"))
    assert n <= seen.value <= 2 * n and all(m.iterations > 2 for m in models)
    monkeypatch.setattr(mm, "FAN_IN", 0)
    for one, other in zip(models, mm.fit_many(store.withColumnRenamed("number", "part"), fits, ("a", "b"))):
        assert np.allclose(one.coefficients, other.coefficients, atol=1e-6) and one.intercept == pytest.approx(other.intercept, abs=1e-6)


def test_many_fits_refuse_one_class(spark):
    rows = spark.createDataFrame([(0, 1, MLVectors.dense([1.0])), (1, 0, MLVectors.dense([2.0]))], ["part", "label", "a"])
    with pytest.raises(ValueError, match="labels 0 and 1"):
        mm.fit_many(rows, [mm.ManyFit(frozenset([0]))], ("a",))


def test_dense_columns_at_the_start_of_a_wide_vector_spare_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 12))
    dense = np.cumsum(base, 1) * 10.0 ** rng.integers(-2, 3, 12)
    sparse = (rng.random((400, 600)) < 0.02) * rng.random((400, 600))
    y = (base[:, 0] + base[:, 5] + sparse[:, 0] + rng.normal(size=400) > 0).astype(int)
    rows = [(MLVectors.dense(np.append(a, b)), int(c)) for a, b, c in zip(dense, sparse, y)]
    train = spark.createDataFrame(rows, ["features", "label"]).repartition(2).cache()
    passes, run = [], mm._pass
    monkeypatch.setattr(mm, "_pass", lambda *args: passes.append(1) or run(*args))
    plain = fit_logistic(train, tolerance=1e-14)
    n = len(passes)
    model = fit_logistic(train, tolerance=1e-14, leading=12)
    assert len(passes) - n < 0.7 * n
    assert np.abs(model.coefficients - plain.coefficients).max() < 1e-4 and abs(model.intercept - plain.intercept) < 1e-4
    train.unpersist()


def test_logistic_scores_names_its_dense_columns(monkeypatch, spark, sf_small, model):
    from catalog import queries

    class Stop(Exception):
        pass

    def seen(train, **params):
        first = train.first()["features"]
        assert params["leading"] == model.dense_size() == 15 + 3 + 10 + 8 + 64 < first.size
        raise Stop

    monkeypatch.setattr(queries, "fit_logistic", seen)
    monkeypatch.setattr(queries, "extractor", lambda spark, sf: ft.FeatureExtractor(src.dictionaries(spark), src.vectors(spark, sf), TINY))
    with pytest.raises(Stop):
        queries.QUERIES["logistic_scores"](spark, sf_small)


def test_train_scope_reads_texts_for_row_features_once(spark, posts, extractor, monkeypatch):
    calls, centers = [], []
    features, similarity = ft.row_features, ft.similarity_to
    monkeypatch.setattr(ft, "row_features", lambda *args: calls.append(1) or features(*args))
    monkeypatch.setattr(ft, "similarity_to", lambda *args: centers.append(1) or similarity(*args))
    rows = posts.withColumn("note", F.lit("x"))
    scored = rg.run_regimes(rows, extractor, ("loo",), fit_scope="train")
    assert len(calls) == len(centers) == 1
    assert scored.count() == posts.count()
    # One model by itself, from its own row features.
    folded, fits = rg.folds_and_fits(rows, ("loo",))
    pooled = folded.withColumn("pool", F.lit("pool"))
    alone = replace(extractor, group_col="pool").fit(pooled.filter(fits[0].train))
    part, wanted = rg._parts(folded, fits)
    store = alone.store(pooled, "dataset", "fold")
    want = rg._scored(store, part, [fits[0]], [wanted[0]], mm.MAX_ITER).select("id", "prediction", "score").collect()
    got = scored.where(F.col("test_dataset") == "p0").select("id", "prediction", "score").collect()
    assert sorted((r.id, r.prediction) for r in got) == sorted((r.id, r.prediction) for r in want)
    known = {r.id: r.score for r in want}
    assert all(r.score == pytest.approx(known[r.id], abs=1e-6) for r in got)


def test_a_fit_at_its_limit_is_reported(spark, caplog):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 6)) * [1, 100, 1, 1, 0.01, 1]
    rows = [(i, MLVectors.dense(a), int(a[0] + a[1] > 0)) for i, a in enumerate(x)]
    model = fit_logistic(spark.createDataFrame(rows, ["id", "features", "label"]), max_iter=2)
    assert convergence(model) == {"iterations": 2, "limit_reached": True, "gradient_norm": model.gradient_norm}
    assert "limit of 2 iterations" in caplog.text


def test_forest_does_not_depend_on_layout(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1300, 12))
    rows = [(i, MLVectors.dense(a), int(a[3] + a[5] > 0.5)) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "tfidf", "label"])
    found = [
        [r["importance"] for r in forest_importances(df.repartition(n), trees=8, depth=4).orderBy("index").collect()]
        for n in (4, 7)
    ]
    assert found[0] == found[1]


def test_transfer_summary(spark):
    rows = [("cv", "reddit", "reddit", 0.6945), ("cross", "reddit", "4chan", 0.7669), ("loo", "all_except_a", "a", 0.1)]
    others = [n for n in ("accuracy_mean", "precision_mean", "recall_mean", "roc_auc_mean")]
    df = spark.createDataFrame(rows, "regime string, train_dataset string, test_dataset string, f1_mean double")
    df = df.withColumns({name: F.lit(0.5) for name in others})
    drops = {r["test_dataset"]: round(r["f1_drop_pct"], 1) for r in rg.transfer_summary(df).collect()}
    assert drops == {"reddit": 0.0, "4chan": -10.4}
    with pytest.raises(ValueError, match="reddit"):
        rg.transfer_summary(df.filter("regime <> 'cv'"))


def test_forest_of_many_rows_has_a_bounded_number_of_tasks(spark, monkeypatch):
    rows = [(i, MLVectors.dense([float(i % 2), float(i % 3)]), i % 2) for i in range(200)]
    seen, fit = [], selection.RandomForestClassifier.fit
    monkeypatch.setattr(selection, "ROWS_PER_TASK", 2)
    monkeypatch.setattr(
        selection.RandomForestClassifier, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df)
    )
    selection.forest_importances(spark.createDataFrame(rows, ["id", "tfidf", "label"]), trees=2, depth=2)
    assert seen == [(selection.MOST_TASKS, 200)]


def test_forest_finds_the_telling_column(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    rows = [(MLVectors.dense(a), int(a[3] > 0.5)) for a in x]
    found = forest_importances(spark.createDataFrame(rows, ["tfidf", "label"]), trees=10, depth=3)
    named = found.withColumns({"term": F.concat(F.lit("t"), "index"), "dataset": F.lit("d")})
    top = select_terms(named, 2).orderBy("rank").collect()
    assert len(top) == 2 and top[0]["term"] == "t3"


def test_alignment(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert align_columns(df, ["b", "c"]).collect() == [(2, 0)]
    weights = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.2)], "id int, term string, weight double")
    known = spark.createDataFrame([("x",), ("z",)], "term string")
    assert [r["term"] for r in align_terms(weights, known).collect()] == ["x"]


def test_planned_fits():
    fits = rg.plan_fits(["a", "b", "c"], 5)
    assert [f.regime for f in fits].count("cv") == 15 and len(fits) == 26
    assert {f.regime for f in rg.plan_fits(["a"], 5)} == {"cv", "global"}


@pytest.mark.parametrize("scope", ["all", "train"])
def test_regimes(extractor, posts, scope, tmp_path):
    regimes = rg.REGIMES if scope == "all" else ("cross", "loo")
    unlabelled = posts.limit(1).withColumns({"id": F.lit(-1).cast("bigint"), "label": F.lit(None).cast("int")})
    rows = posts.unionByName(unlabelled)
    scored = rg.run_regimes(rows, extractor, regimes, k=2, fit_scope=scope, max_iter=10)
    n = posts.count()
    counts = {r["regime"]: r["count"] for r in scored.groupBy("regime").count().collect()}
    # cross scores each row once per other dataset; the others score each row once.
    assert counts == {"cross": 2 * n, **{r: n for r in regimes if r != "cross"}}
    assert scored.filter("regime = 'cross' and train_dataset = test_dataset").count() == 0
    summary = rg.overall_summary(scored)
    # Every labelled row is tested, and the short limit shows.
    tested = sum(F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives"))
    assert summary.filter("regime = 'loo'").agg(F.sum(tested)).first()[0] == n
    assert summary.filter("max_iterations > 10 or n_limit_reached > n_folds").count() == 0
    assert summary.count() == {"all": 3 + 6 + 3 + 3, "train": 6 + 3}[scope]
    assert summary.filter("n_folds <> 2").count() == 0
    nested = rg.nested_summary(scored)
    assert nested.count() == len(regimes)
    wr.save_json(nested, str(tmp_path / "summary"))


def test_train_and_test_rows_are_disjoint(posts):
    from corpuslens.operators.splits import stratified_folds

    rows = stratified_folds(posts, k=3)
    for fit in rg.plan_fits(["p0", "p1", "p2"], 3):
        assert rows.filter(fit.train & fit.test).isEmpty()


def test_unknown_scope(extractor, posts):
    with pytest.raises(ValueError):
        rg.run_regimes(posts, extractor, fit_scope="some")


def test_ablation(extractor, posts):
    results = ab.run_ablation(posts, extractor, max_iter=10).collect()
    assert len(results) == 33
    sizes = {r["experiment"]: r["n_features"] for r in results if r["dataset"] == "p0"}
    assert sizes["A_FULL"] == 140 and sizes["C_LEXICAL_ONLY"] == 15 and sizes["G_NO_TFIDF"] == 100
