"""Alignments made of the given tables, whole: every text, every vector, every row.

``text_alignment``: each text is cut into consecutive rows of ``TEXT_COLUMNS`` letters, the last one
filled with gaps. ``vector_alignment``: each embedding is a row, each of its dimensions a letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_COLUMNS = 60
ROWS_A_TEXT = 1_000_000
#: Letters of a vector's dimensions are steps of WIDTH from LOW; below LOW is a gap, all above the last step are one.
LOW, WIDTH, STEPS = -0.3, 0.12, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of files that would be read by fewer tasks than there are cores, dealt to all of them; others as they are.

    A small table is often one row group, which one task reads; what is done with its rows should not be.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def text_alignment(docs: DataFrame, columns: int = TEXT_COLUMNS) -> DataFrame:
    """(seq_id, hd, seq) of ``docs(doc_id, text, lang, source)``; characters that are no letter of the alphabet are gaps."""
    docs = spread(docs.select("doc_id", "text", "lang", "source"), "doc_id")
    letters = F.upper(F.regexp_replace("text", "[^AC-IK-NP-TVWYac-ik-np-tvwy]", "-"))
    rows = docs.where("length(text) > 0").select("doc_id", "lang", "source", letters.alias("letters"))
    cut = rows.select("doc_id", "lang", "source", F.posexplode(F.regexp_extract_all("letters", F.lit(f".{{1,{columns}}}"), 0)).alias("k", "row"))
    hd = F.concat_ws("|", F.concat("source", F.lit("/"), "doc_id"), "lang", "k")
    return cut.select((F.col("doc_id") * ROWS_A_TEXT + F.col("k")).alias("seq_id"), hd.alias("hd"), F.rpad("row", columns, "-").alias("seq"))


def vector_alignment(vectors: DataFrame) -> DataFrame:
    """(seq_id, hd, seq, label) of ``vectors(vec_id, embedding, label)``."""
    step = lambda x: F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor((x.cast("double") - LOW) / WIDTH).cast("int") + 1))
    seq = F.array_join(F.transform("embedding", lambda x: F.substring(F.lit("-ACDEFG"), step(x) + 1, F.lit(1))), "")
    return vectors.select(F.col("vec_id").alias("seq_id"), F.concat_ws("|", "vec_id", F.concat(F.lit("label"), "label")).alias("hd"), seq.alias("seq"), "label")


#: The same in SQL.
TEXT_SQL = rf"""
  SELECT doc_id * {ROWS_A_TEXT} + k AS seq_id, concat_ws('|', source || '/' || doc_id, lang, k) AS hd,
    rpad(upper(regexp_replace(regexp_replace(substr(text, k * {TEXT_COLUMNS} + 1, {TEXT_COLUMNS}), '[^A-Za-z]', '-', 'g'), '[BJOUXZbjouxz]', '-', 'g')), {TEXT_COLUMNS}, '-') AS seq
  FROM (SELECT *, unnest(range((length(text) - 1) // {TEXT_COLUMNS} + 1)) AS k FROM documents WHERE length(text) > 0)"""
VECTOR_SQL = rf"""
  SELECT vec_id AS seq_id, concat_ws('|', vec_id, 'label' || label) AS hd, label,
    list_aggregate([substr('-ACDEFG', CAST(greatest(0, least({STEPS}, floor((CAST(x AS DOUBLE) - ({LOW})) / {WIDTH}) + 1)) AS INTEGER) + 1, 1) for x in embedding], 'string_agg', '') AS seq
  FROM embeddings"""
