"""Fitted feature models as tables, to be opened in another session."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from corpuslens.operators.tfidf import TfidfEstimator, TfidfModel
from corpuslens.plans.features import Dictionaries, FeatureExtractor, FeatureModel, Settings, Vectors
from corpuslens.session import sized

# Changes with the meaning of the tables or settings.
VERSION = 1


def _shape(df: DataFrame) -> list[list[str]]:
    return [[f.name, f.dataType.simpleString()] for f in df.schema]


def save_model(model: FeatureModel, path: str) -> None:
    """Write the fitted tables under ``path``, which must be free, and the settings last: without them nothing can be opened.

    User tables (dictionaries, vectors) are not part of a model; they are given again when it is opened.
    """
    tables = {"tfidf": model.tfidf.state, "selected": model.selected, "neutral": model.neutral}
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
    plan = model.plan
    state = {
        "version": VERSION,
        "settings": asdict(plan.settings),
        "group_col": plan.group_col,
        "tfidf": {"max_features": plan.settings.max_tfidf_features, "id_col": model.tfidf.id_col, "text_col": model.tfidf.text_col},
        "vectors": {"size": plan.vectors.size, "keys": list(plan.vectors.keys)},
        "shapes": {name: _shape(table) for name, table in tables.items()},
    }
    spark = model.selected.sparkSession
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/settings")


def load_model(spark: SparkSession, path: str, dictionaries: Dictionaries, vectors: Vectors) -> FeatureModel:
    """The model saved under ``path``; refused if version, tables or vectors differ from what was saved."""
    state = json.loads(spark.read.text(f"{path}/settings").first()[0])
    if state["version"] != VERSION:
        raise ValueError(f"model of version {state['version']}, this is version {VERSION}")
    given = {"size": vectors.size, "keys": list(vectors.keys)}
    if given != state["vectors"]:
        raise ValueError(f"the model needs vectors with {state['vectors']}, got {given}")
    tables = {}
    for name, shape in state["shapes"].items():
        found = spark.read.parquet(f"{path}/{name}")
        if _shape(found) != shape:
            raise ValueError(f"table {name!r} has columns {_shape(found)}, saved were {shape}")
        tables[name] = sized(found)
    plan = FeatureExtractor(dictionaries, vectors, Settings(**state["settings"]), state["group_col"])
    tfidf = TfidfModel(tables["tfidf"], TfidfEstimator(group_col=state["group_col"], **state["tfidf"]))
    return FeatureModel(plan, tfidf, tables["selected"], tables["neutral"])
