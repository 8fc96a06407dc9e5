"""The operators on the given tables, one query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import (
    bpe, collocations, decontaminate, exact, html, jaccard, lm_score, oracles, prefix_trie, quality, quality_rules, sharding, toxicity, urls,
)
from corpuslens.llm.common import table
from corpuslens.session import written

# Scores from here on count as label 1.
REJECT = 0.7
# Verdict, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
COLLOCATIONS = {"min_count": 100, "longest": 5, "top": 2000}
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return token_digests(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True))


def token_digests(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(remainder(3) != 1).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(docs, labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return judged(scored, remainder(3) == 1)


def judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = exact.DigestIndex(spark).add(table(spark, sf_dir, "documents"))
    return decisions.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2).select("doc_id", F.col("quality").alias("label"))
    return judged(quality.score(stats, quality.fit(stats, labels)), remainder(4) == 2)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.Join(table(spark, sf_dir, "documents"), size=3, percent=90).groups()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), **COLLOCATIONS)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    head_length = F.crc32(conv_id.cast("string")) % 9
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), conv_id - conv_id % 5, head_length)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_lm_score": op4_lm_score,
    "op5_html": op5_html,
    "op6_url_filter": op6_url_filter,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_quality_rules": op12_quality_rules,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op3_sharding": oracles.shards(SHARDS),
    "op6_url_filter": oracles.url_filter(URL_RULES),
    "op7_exact_dedup": oracles.EXACT,
    "op11_collocations": oracles.collocations(**COLLOCATIONS),
    "op13_prefix_trie": oracles.TRIE,
}
