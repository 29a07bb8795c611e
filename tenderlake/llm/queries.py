"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import bpe, chat, decontaminate, exact_dedup, language, licenses, line_dedup, merkle, near_dedup, quality, repair, secret_scan, toxicity
from tenderlake.llm.store import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    leaks = decontaminate.find_leaks(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return leaks.drop("h")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, folder), stays="largest")


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_dedup.near_groups(_documents(spark, folder))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_documents(spark, folder))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{folder}/conversations.parquet"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held_out = language.held_out(F.col("doc_id"), 5, 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    held_out = language.held_out(F.col("doc_id"), 3, 1)
    found = language.identify(docs, language.train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_byte_bpe(spark: SparkSession, folder: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Ranks and pattern of the public tokenizer unless others are given."""
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(_documents(spark, folder), ranks, pattern or public_tokenizers.PATTERN))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, folder))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_secrets(_documents(spark, folder))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    rated = quality.rate(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    return rated.select("doc_id", *quality.BASE, "base_failed", "kept", "quality_score")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return repair.repair(spark.read.parquet(f"{folder}/conversations.parquet"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(_documents(spark, folder))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op3_chat_format": op3_chat_format,
    "op6_byte_bpe": op6_byte_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op7_near_dedup": op7_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {
    "op2_exact_dedup": """
        with hashed as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
             best as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from hashed group by 1)
        select h.doc_id, b.keep_id, b.group_size, h.doc_id = b.keep_id as kept, h.text_sha256
        from hashed h join best b using (text_sha256)
    """,
}
