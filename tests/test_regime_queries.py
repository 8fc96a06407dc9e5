import inspect

import pytest
from pyspark.sql import functions as F

from catalog import queries
from corpuslens.plans.features import Settings
from corpuslens.plans.regimes import REGIMES, run_regimes


class Called(Exception):
    pass


@pytest.mark.parametrize("name, regimes", [("overall_summary", REGIMES), ("regime_transfer", ("cv", "cross"))])
def test_regimes_are_run_whole(spark, sf_small, monkeypatch, name, regimes):
    """All folds, the default vocabulary and its selection."""

    def record(*args, **kwargs):
        raise Called(inspect.signature(run_regimes).bind(*args, **kwargs))

    monkeypatch.setattr(queries.rg, "run_regimes", record)
    with pytest.raises(Called) as caught:
        queries.QUERIES[name](spark, sf_small)
    bound = caught.value.args[0]
    bound.apply_defaults()
    assert bound.arguments["regimes"] == regimes and bound.arguments["k"] == 5
    assert bound.arguments["extractor"].settings == Settings(seed=queries.src.SEED)


def test_planned_rows_are_those_that_are_scored(spark, sf_small):
    """``regime_rows`` comes from the plan; a run of the regimes scores just these rows."""
    from dataclasses import replace

    posts = queries.src.posts(spark, sf_small)
    plan = queries.extractor(spark, sf_small, max_tfidf_features=50, tfidf_selection_method="none")
    scored = run_regimes(posts, replace(plan), seed=queries.src.SEED, fit_scope="all", max_iter=3)
    counted = scored.groupBy("regime", "train_dataset", "test_dataset", "fold").agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("n_positive")
    )
    planned = queries.QUERIES["regime_rows"](spark, sf_small)
    assert sorted(map(tuple, planned.collect())) == sorted(map(tuple, counted.collect()))
