"""The corpus pipeline: five stages, each over all that the one before kept.

quality classifier, near-duplicates, benchmark decontamination, secret scans, mixing. Every stage takes
``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` applies them to ``documents``, each written before the next.

Every stage takes ``docs`` with COLUMNS and maybe others, of any name, which go. Nulls in any column, repeated rows, ties, empty and
very long texts and an empty table are allowed; each stage says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.llm import decontaminate, mixing, neardup, quality, secretscan
from covarium.llm.shared import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (neither junk nor toxic).

    Null, empty and white texts go; null sources and languages are sites of their own; rows without doc_id and repeated rows are
    judged like all others.
    """
    return quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates.

    Rows without doc_id and texts without words stay, and so do all repeats of a row that stays.
    """
    kept = neardup.near_duplicate_texts(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    return neardup.hashed(docs.select(*COLUMNS)).join(kept, same, "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null, empty and white texts stay. All rows of a doc_id of which one leaks go; rows without doc_id are told apart by their text.
    """
    named = docs.select(*COLUMNS).withColumn("_key", F.coalesce(F.col("doc_id"), F.xxhash64("text")))
    found = decontaminate.leaks(named.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return named.join(found, "_key", "left_anti").select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text; null and empty texts stay as they are, and n_chars follows the text."""
    return secretscan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: one row for each chosen document and epoch, with the text.

    Null, empty and white texts are in no epoch; null levels count as ''; repeats of a doc_id tie, and are cut together.
    """
    return mixing.production(docs.select(*COLUMNS), keep=COLUMNS)


STAGES = [
    ("quality", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("mixing", mixed),
]

#: No SQL: the classifier is fitted and near-duplicates are sketched; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
