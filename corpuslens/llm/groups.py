"""Groups back to the rows that form them, without gathering a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import written

# A group is hot with more than this share of the rows, so fewer than 1 / HOT_SHARE groups are broadcast.
HOT_SHARE = 0.001


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of the group that has their ``key`` (binary), null without one.

    ``size`` is the column with a group's number of rows. Hot groups come by broadcast; their rows, and rows without a
    key, then join under a key of their own.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = groups.where(F.col(size) > max(1, HOT_SHARE * total)).select(key, F.struct(*names).alias("_hot"))
    rows = rows.join(F.broadcast(hot), key, "left")
    own = F.unhex(F.hex(F.xxhash64(*(c for c in rows.columns if c not in (key, "_hot")))))
    rows = rows.withColumn("_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(own))
    cold = groups.select(F.col(key).alias("_key"), F.struct(*names).alias("_cold"))
    rows = rows.join(cold, "_key", "left")
    return rows.select(*(c for c in rows.columns if c[0] != "_"), F.coalesce("_hot", "_cold").alias("_group")).select(
        "*", *(F.col(f"_group.{name}") for name in names)
    ).drop("_group")


# Bits of a bitmap of keys; it has at most BITMAP / 64 rows, whatever the number of keys.
BITMAP = 1 << 20


def split_by(rows: DataFrame, keys: DataFrame, on: dict[str, Column], bits: int = BITMAP) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have one of ``keys``, and ``rows`` that surely have none; neither is shuffled.

    ``on`` has, by column name of ``keys``, the same value of a row. A bitmap of the keys' hashes is broadcast; what it
    lets through is left for an exact join, which then shuffles few rows. With more keys than ``bits`` it lets most through.
    """

    def place(*columns):
        return F.pmod(F.xxhash64(*columns), F.lit(bits))

    word, bit = F.expr("_at DIV 64"), F.expr("shiftleft(1L, int(_at % 64))")
    marks = keys.select(place(*map(F.col, on)).alias("_at")).select(word.alias("_word"), bit.alias("_bit"))
    bitmap = written(marks.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "bitmap")
    packed = rows.select(F.struct("*").alias("_row"), place(*on.values()).alias("_at"))
    packed = packed.withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return packed.where(hit).select("_row.*"), packed.where(~hit).select("_row.*")
