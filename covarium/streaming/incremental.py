"""Letter counts of a stream of sequences.

With fixed weights (1 each) single-site counts are sums, so that a running aggregation by position
and letter keeps them: the state has 21 numbers for each column, whatever the stream's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covarium.functions import encode


def running_counts(sequences: DataFrame) -> DataFrame:
    """(pos, code, n) of a streaming (or batch) ``(seq_id, seq)``; gaps are code 0. Write in complete or update mode."""
    cells = encode.cells(sequences.select("seq_id", "seq"), gaps=True)
    return cells.groupBy("pos", "code").agg(F.count("*").alias("n"))


def frequencies(counts: DataFrame) -> DataFrame:
    """(pos, code, f) of a snapshot of the counts."""
    total = F.sum("n").over(Window.partitionBy("pos"))  # 21 rows each
    return counts.withColumn("total", total).where("code > 0").select("pos", "code", (F.col("n") / F.col("total")).alias("f"))
