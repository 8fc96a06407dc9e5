"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text (A-Z lower-cased, SHA-256). New rows are
grouped by digest; groups the index has are found by a sort-merge join that shuffles only the new side, and the digests
it lacks are appended. Texts are never shuffled, only digests and ids.

Defined results: null text is empty text, and all empty texts are equal. Of equal texts the row with the largest id
stays; a null id is the smallest. If rows repeat with text and id, one of them stays. An empty table changes nothing.
Only the id and text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import ascii_lower, id_and_text
from corpuslens.llm.groups import attach, split_by
from corpuslens.session import new_table_path, written


def digest(text):
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """``digest, keep_id`` of every text kept so far, at ``location`` in ``buckets`` sorted buckets.

    An index that is there is opened; ``buckets`` must then be what it was made with.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.location = location or new_table_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) "
            f"SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def _append(self, rows: DataFrame) -> None:
        writer = rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append the batch's new digests; returns its decisions.

        One row per input row: ``doc_id, digest, keep_id`` (the row that stays, perhaps of an earlier batch),
        ``group_size`` (equal rows of this batch), ``kept``.
        """
        plain = id_and_text(docs, id_col, text_col).select("doc_id", digest(F.col("text")).alias("digest"))
        # Rows that repeat with id and text become one, so later steps see distinct pairs.
        pairs = written(plain.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")
        groups = pairs.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.sum("copies").alias("group_size"))
        known = self.rows().select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
        judged = written(groups.join(known.hint("merge"), "digest", "left"), "groups")
        self._append(judged.where("known IS NULL").select("digest", F.col("last_id").alias("keep_id")))
        names = ["known", "known_id", "last_id", "group_size"]
        rows = attach(pairs, judged, "digest", "group_size", names)
        rows = rows.withColumn("copy", F.explode(F.expr("sequence(1, int(copies))")))
        return rows.select(
            "doc_id",
            "digest",
            F.when(F.col("known"), F.col("known_id")).otherwise(F.col("last_id")).alias("keep_id"),
            "group_size",
            (F.col("known").isNull() & F.col("doc_id").eqNullSafe(F.col("last_id")) & (F.col("copy") == 1)).alias("kept"),
        )


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the index keeps, with all their columns."""
    decisions = written(index.add(docs, id_col, text_col).select("doc_id", "digest", "kept"), "decisions")
    # A row none of whose like is dropped stays where it is; only the others are looked up.
    on = {"digest": digest(F.col(text_col)), "doc_id": F.col(id_col)}
    doubtful, sure = split_by(docs, decisions.where("NOT kept"), on)
    kept = decisions.where("kept").select(F.col("doc_id").alias("kept_id"), "digest")
    rows = doubtful.select(F.struct("*").alias("row"), on["doc_id"].alias("row_id"), on["digest"].alias("row_digest"))
    rows = rows.join(kept, (F.col("row_digest") == F.col("digest")) & F.col("row_id").eqNullSafe(F.col("kept_id")), "left_semi")
    # Only rows that repeat with id and text share these keys.
    order = Window.partitionBy("row_digest", "row_id").orderBy(F.xxhash64("row"))
    rows = rows.withColumn("copy", F.row_number().over(order)).where("copy = 1")
    return sure.unionByName(rows.select("row.*"))
