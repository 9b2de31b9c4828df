"""Registered queries of this package: ``opN_<name>`` for each operator, and ``pipeline``."""

from __future__ import annotations

from pyspark.sql import functions as F

from covarium.llm import chatformat, decontaminate, language, mixing, neardup, quality, qualityrules, repair, secretscan, suffixes, tokencount, webp, whitening
from covarium.llm.shared import table


def op1_mixing(spark, sf_dir):
    return mixing.production(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.classify(docs, table(spark, sf_dir, "labels")).drop("text", "lang", "source")


def op3_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    attack = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(chatformat.ATTACK).alias("text"),
    )
    return chatformat.digest(chatformat.read_chats(chatformat.format_chats(rows.union(attack))))


def op5_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text", "spans")


def op6_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark, sf_dir):
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents")))


def op8_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op9_media_webp(spark, sf_dir):
    stored = webp.store(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op10_token_count(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return qualityrules.judge(docs.select("doc_id", F.col("source").alias("host"), "text"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark, sf_dir):
    return repair.repair(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality_classifier, op3_minhash_neardup, op4_chat_format, op5_suffix_dedup, op6_decontaminate, op7_secret_scan, op8_language_id, op9_media_webp, op10_token_count, op11_quality_rules, op12_whitening, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op1_mixing": mixing.ORACLE_SQL, "op4_chat_format": chatformat.ORACLE_SQL, "op11_quality_rules": qualityrules.ORACLE_SQL, "op13_conversation_repair": repair.ORACLE_SQL}
