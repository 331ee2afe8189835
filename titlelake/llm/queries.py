"""The operators over their whole tables, by query name, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlelake.llm import (
    decontaminate, langid, licenses, minhash, packing, pii, quality, search, secrets, sharding, simhash, spelling, statements, toxicity,
)
from titlelake.llm.common import bucket

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
HELD_OUT_LANG = 5
HELD_OUT_TOXIC = 3
TOXIC_FROM = 0.7
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find(docs, secrets.fit(docs))
    return found.select("row.doc_id", *[f"n_{k}" for k in secrets.KINDS[: secrets.NET]], "base_sha256", "spans")


def op3_pack_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(VOCABULARY)
    added = packing.added_tokens(public_tokenizers.path(TOKENIZER))
    packed = packing.pack(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, added=added)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    return found.select("row.doc_id", *[f"n_{k}" for k in pii.KINDS[: pii.WEAK]], "base_sha256", "spans")


def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    identity = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = sharding.interleaved(rows, F.col("source"), identity, SHARDS)
    return placed.select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row.source",
    )


def op6_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(bucket(F.col("doc_id"), HELD_OUT_TOXIC) != 1))
    held_out = F.coalesce(bucket(F.col("row.doc_id"), HELD_OUT_TOXIC) == 1, F.lit(False))
    predicted = (F.col("score") >= TOXIC_FROM).cast("int")
    scored = toxicity.score(docs, model)
    return scored.select("row.doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "spans")


def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.overlaps(docs, benchmark).drop("row")


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Fitted on the documents that aren't held out."""
    return langid.fit(docs.filter(bucket(F.col("doc_id"), HELD_OUT_LANG) != 0))


def op8_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    held_out = F.coalesce(bucket(F.col("row.doc_id"), HELD_OUT_LANG) == 0, F.lit(False))
    return found.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "log_ppl")


def op10_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_frequency_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Query] = {
    "op1_license_dice": op1_license_dice,
    "op2_secret_network": op2_secret_network,
    "op3_pack_vectors": op3_pack_vectors,
    "op4_pii_weak_supervision": op4_pii_weak_supervision,
    "op5_interleaved_shards": op5_interleaved_shards,
    "op6_toxic_crf": op6_toxic_crf,
    "op7_spaced_seed_decontamination": op7_spaced_seed_decontamination,
    "op8_word_backoff_langid": op8_word_backoff_langid,
    "op9_kneser_ney_quality": op9_kneser_ney_quality,
    "op10_simhash_ball": op10_simhash_ball,
    "op11_limited_accumulators": op11_limited_accumulators,
    "op12_tensored_minhash": op12_tensored_minhash,
    "op13_frequency_trie": op13_frequency_trie,
}
LLM_ORACLE: dict[str, str] = {
    "op1_license_dice": statements.LICENSES,
    "op7_spaced_seed_decontamination": statements.DECONTAMINATION,
    "op11_limited_accumulators": statements.SEARCH,
    "op12_tensored_minhash": statements.NEAR_DUPLICATES,
}
