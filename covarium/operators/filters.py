"""Filters of sequences and positions. All limits are strict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions import encode
from covarium.operators.counts import letter_sums


def require_rectangular(msa: DataFrame) -> int:
    """The common length of all sequences; raises if there is none."""
    low, high = msa.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if low != high:
        raise ValueError(f"sequences have lengths from {low} to {high}; an alignment needs one")
    return low or 0


def standard_only(msa: DataFrame) -> DataFrame:
    return msa.where(encode.is_standard(F.col("seq")))


def by_sequence(msa: DataFrame, max_gaps: float = 0.2, reference: str | None = None, min_identity: float = 0.2, max_identity: float = 0.8, upper_bound: bool = True) -> DataFrame:
    """Sequences with fewer gaps, and with an identity to the reference sequence between the bounds."""
    out = msa.where(encode.gap_fraction(F.col("seq")) < max_gaps)
    if reference is not None:
        same = encode.identity(F.col("seq"), F.lit(reference))
        out = out.withColumn("_same", same).where(F.col("_same") > min_identity)
        out = (out.where(F.col("_same") < max_identity) if upper_bound else out).drop("_same")
    return out


def position_gaps(msa: DataFrame, weights: DataFrame | Column | None = None) -> DataFrame:
    """(pos, gap_fraction), weighted if weights are given, as a table (seq_id, w) or a column of ``msa``, and their sum is positive."""
    sums = letter_sums(msa, weights)
    gap = lambda c: F.sum(F.when(F.col("code") == 0, F.col(c)).otherwise(0)) / F.sum(c)
    return sums.groupBy("pos").agg(F.when(F.sum("s") > 0, gap("s")).otherwise(gap("n")).alias("gap_fraction"))


def kept_positions(msa: DataFrame, max_gaps: float = 0.2, weights: DataFrame | Column | None = None) -> list[int]:
    """Positions with fewer gaps: one number for each column of the alignment comes to the driver."""
    return [r["pos"] for r in position_gaps(msa, weights).where(F.col("gap_fraction") < max_gaps).select("pos").orderBy("pos").collect()]


def by_position(msa: DataFrame, max_gaps: float = 0.2, weights: DataFrame | Column | None = None) -> tuple[DataFrame, list[int]]:
    keep = kept_positions(msa, max_gaps, weights)
    return msa.withColumn("seq", encode.pick(F.col("seq"), keep)), keep


def by_length(msa: DataFrame, tolerance: float) -> DataFrame:
    """Sequences whose ungapped length is within ``tolerance`` of the mean."""
    size = F.length(encode.ungapped(F.col("seq")))
    mean = msa.agg(F.avg(size).alias("_mean"))
    return msa.crossJoin(F.broadcast(mean)).where((size > F.col("_mean") - tolerance) & (size < F.col("_mean") + tolerance)).drop("_mean")


def by_species(msa: DataFrame, species: str) -> DataFrame:
    return msa.where(F.contains(F.lower("hd"), F.lit(species.lower())))


def family(msa: DataFrame, text: str, ignore_case: bool = True) -> DataFrame:
    """(seq_id) of the sequences whose header has ``text``."""
    hd, text = (F.lower("hd"), text.lower()) if ignore_case else (F.col("hd"), text)
    return msa.where(F.contains(hd, F.lit(text))).select("seq_id")


def keep_indices(wanted: DataFrame, n: int) -> DataFrame:
    """Sorted distinct 0-based row numbers inside the alignment; the others are dropped."""
    return wanted.where((F.col("i") >= 0) & (F.col("i") < n)).distinct().orderBy("i")
