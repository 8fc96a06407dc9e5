"""1-2-gram TF-IDF as distributed aggregations, fitted per group of rows.

Definition: terms of two or more characters and their bigrams; vocabulary = the most
frequent terms of the corpus, ties by term; idf = ln((1+n)/(1+df)) + 1; weight =
(1 + ln tf) * idf, scaled to unit length per row over the vocabulary.

Terms are counted in numpy on Arrow batches (``operators/terms.py``), so what Spark groups
and shuffles are counts of many rows, not single occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.text import clean_text, ngrams, with_tokens
from corpuslens.functions.vectors import sparse
from corpuslens.operators.terms import count_terms, weigh_terms
from corpuslens.session import sized, small_table


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``.

    Evaluate it under ``early_limit``: every task then passes on at most ``k`` rows per
    group, so a group that holds most of the table is never sorted whole in one place.
    """
    per_group = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(per_group)).filter(F.col("rank") <= k)


_threshold_lock = Lock()
_threshold_users: list[str] = []


@contextmanager
def early_limit(spark: SparkSession, k: int) -> Iterator[None]:
    """Let Catalyst cut ranked groups before the shuffle for limits up to ``k``.

    Fits may run side by side; the last one to leave restores the session's setting.
    """
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    with _threshold_lock:
        current = spark.conf.get(name)
        _threshold_users.append(_threshold_users[0] if _threshold_users else current)
        spark.conf.set(name, str(max(int(current), k)))
    try:
        yield
    finally:
        with _threshold_lock:
            before = _threshold_users.pop()
            if not _threshold_users:
                spark.conf.set(name, before)


def term_statistics(df: DataFrame, group: str = "dataset", text_col: str = "text") -> DataFrame:
    """``(group, term, total, df)``: corpus count and document frequency in one pass."""
    field = df.schema[group]
    rows = df.select(F.col(group).alias("group"), clean_text(F.col(text_col)).alias("clean"))
    schema = T.StructType([T.StructField("group", field.dataType)]).add("term", "string").add("total", "long").add("df", "long")
    counts = rows.mapInArrow(count_terms, schema)
    return counts.groupBy(F.col("group").alias(group), "term").agg(
        F.sum("total").alias("total"), F.sum("df").alias("df")
    )


def smoothed_idf(n_rows: Column, df: Column) -> Column:
    return F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + df)) + F.lit(1.0)


def vocabulary(stats: DataFrame, group: str, max_features: int) -> DataFrame:
    return top_per_group(stats, group, [F.desc("total"), F.asc("term")], max_features)


class TfidfEstimator(Estimator):
    """Learns one vocabulary with idf weights per value of ``group_col``."""

    def __init__(
        self,
        max_features: int = 10_000,
        group_col: str = "dataset",
        id_col: str = "id",
        text_col: str = "text",
    ):
        super().__init__()
        self.max_features = max_features
        self.group_col = group_col
        self.id_col = id_col
        self.text_col = text_col

    def _fit(self, dataset: DataFrame) -> TfidfModel:
        group = self.group_col
        sizes = sized(dataset.groupBy(group).agg(F.count("*").alias("n_rows")))
        chosen = vocabulary(
            term_statistics(dataset, group, self.text_col), group, self.max_features
        )
        position = Window.partitionBy(group).orderBy("term")
        state = chosen.join(sizes, group).select(
            group,
            "term",
            "rank",
            (F.row_number().over(position) - 1).alias("index"),
            "total",
            "df",
            "n_rows",
            smoothed_idf(F.col("n_rows"), F.col("df")).alias("idf"),
        )
        with early_limit(dataset.sparkSession, self.max_features):
            return TfidfModel(sized(state), self)


class TfidfModel(Model):
    """Fitted vocabulary ``(group, term, rank, index, total, df, n_rows, idf)``.

    ``rank`` orders terms by count, ``index`` alphabetically, i.e. by column.
    """

    def __init__(self, state: DataFrame, settings: TfidfEstimator):
        super().__init__()
        self.state = state
        self.group_col = settings.group_col
        self.id_col = settings.id_col
        self.text_col = settings.text_col

    def _rows(self, dataset: DataFrame) -> DataFrame:
        """Rows hashed by key while they are still plain text, far smaller than their terms."""
        group, key = self.group_col, self.id_col
        return dataset.select(group, key, self.text_col).repartition(group, key)

    def _hits(self, dataset: DataFrame, term_key: str) -> DataFrame:
        """``(group, id, term_key, weight)`` before scaling, for a vocabulary beyond the bound of a broadcast."""
        group, key = self.group_col, self.id_col
        terms = with_tokens(self._rows(dataset), self.text_col).select(
            group, key, F.explode(ngrams(F.col("tokens"))).alias("term")
        )
        known = terms.join(self.state.select(group, "term", "index", "idf"), [group, "term"])
        counted = known.groupBy(group, key, term_key, "idf").agg(F.count("*").alias("tf"))
        weight = (F.lit(1.0) + F.log("tf")) * F.col("idf")
        return counted.select(group, key, term_key, weight.alias("weight"))

    def _weighed(self, dataset: DataFrame) -> DataFrame | None:
        """``(group, id, terms, indices, weights)``: arrays of the known terms of each key that has one, by index.

        A task holds the vocabulary and one slice of its rows, which are sorted by key. None if
        the vocabulary is beyond the bound of side tables.
        """
        group, key = self.group_col, self.id_col
        table = small_table(self.state.select(F.col(group).alias("group"), "term", "index", "idf"))
        if table is None:
            return None
        rows = self._rows(dataset).sortWithinPartitions(group, key)
        rows = rows.select(
            F.col(group).alias("group"), F.col(key).alias("key"), clean_text(F.col(self.text_col)).alias("clean")
        )
        fields = [T.StructField("group", rows.schema["group"].dataType), T.StructField("key", rows.schema["key"].dataType)]
        schema = T.StructType(fields)
        for name, of in (("terms", T.StringType()), ("indices", T.IntegerType()), ("weights", T.DoubleType())):
            schema = schema.add(name, T.ArrayType(of))
        found = rows.mapInArrow(weigh_terms(table), schema)
        return found.withColumnsRenamed({"group": group, "key": key})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Long table ``(group, id, term, weight)``; unknown terms are dropped."""
        group, key = self.group_col, self.id_col
        weighed = self._weighed(dataset)
        if weighed is not None:
            cells = weighed.select(group, key, F.explode(F.arrays_zip("terms", "weights")).alias("cell"))
            return cells.select(group, key, F.col("cell.terms").alias("term"), F.col("cell.weights").alias("weight"))
        per_row = Window.partitionBy(group, key)
        length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(per_row))
        return self._hits(dataset, "term").withColumn("weight", F.col("weight") / length)

    def sizes(self) -> dict[str, int]:
        """Vocabulary size per group."""
        counts = self.state.groupBy(self.group_col).count().collect()
        return {r[self.group_col]: r["count"] for r in counts}

    def transform_sparse(self, dataset: DataFrame, name: str = "tfidf") -> DataFrame:
        """``(group, id, name)`` with one sparse vector per row that has a known term."""
        group, key = self.group_col, self.id_col
        pairs = [F.lit(x) for pair in self.sizes().items() for x in pair]
        size = F.create_map(*pairs)[F.col(group)] if pairs else F.lit(0)
        weighed = self._weighed(dataset)
        if weighed is not None:
            return weighed.select(
                group, key, sparse(size, F.col("indices"), F.col("weights")).alias(name)
            )
        rows = self._hits(dataset, "index").groupBy(group, key).agg(
            F.sort_array(F.collect_list(F.struct("index", "weight"))).alias("cells"),
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"),
        )
        scaled = F.transform("cells", lambda c: c["weight"] / F.col("length"))
        return rows.select(
            group, key, sparse(size, F.col("cells.index"), scaled).alias(name)
        )
