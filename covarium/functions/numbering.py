"""Consecutive row numbers in the order of a key, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covarium.functions.settle import settle


def offsets(rows: DataFrame, at: str) -> DataFrame:
    """(_part, _before): the rows before each partition of ``monotonically_increasing_id`` numbers; one row for each partition."""
    counts = rows.groupBy(F.shiftright(at, 33).alias("_part")).agg(F.count("*").alias("_n"))
    return counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))


def numbered(rows: DataFrame, key: str | Column | list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name`` = 0, 1, 2, ... by ascending ``key``, one column or several (ties get numbers in any order).

    Rows are dealt to ranges of about equal counts, whatever the keys' distribution, and sorted inside them; a range's first
    number is the count of all before it.
    """
    keys = key if isinstance(key, list) else [key]
    dealt = settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets(dealt, "_at")), "_part").withColumn(name, (F.col("_before") + own).cast("long")).drop("_part", "_before", "_at")
