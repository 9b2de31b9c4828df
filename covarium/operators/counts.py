"""Letter counts of an alignment in one pass: what frequencies, gap shares and couplings start from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions.encode import LETTERS
from covarium.operators.blocks import codes_in


def weighted(msa: DataFrame, weights: DataFrame | Column | None) -> DataFrame:
    """(seq_id, seq, w): weights of a table (seq_id, w), a column of ``msa``, or 1 each. A column costs no join."""
    if isinstance(weights, Column):
        return msa.select("seq_id", "seq", weights.cast("double").alias("w"))
    rows = msa.select("seq_id", "seq")
    return rows.withColumn("w", F.lit(1.0)) if weights is None else rows.join(weights.select("seq_id", "w"), "seq_id")


def _letter_batches(batches):
    sums = count = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = codes_in(batch.column(0))
        n, length = codes.shape
        if sums is None:
            sums, count = np.zeros(length * (LETTERS + 1)), np.zeros(length * (LETTERS + 1), np.int64)
        elif len(sums) != length * (LETTERS + 1):
            raise ValueError("sequences have several lengths; an alignment needs one")
        key = (codes + np.arange(length) * (LETTERS + 1)).ravel()
        sums += np.bincount(key, weights=np.repeat(batch.column(1).to_numpy(), length), minlength=len(sums))
        count += np.bincount(key, minlength=len(sums))
    if sums is not None:
        some = np.flatnonzero(count)
        pos, code = np.divmod(some, LETTERS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(count[some]), pa.array(sums[some])], ["pos", "code", "n", "s"])


def letter_sums(msa: DataFrame, weights: DataFrame | Column | None = None) -> DataFrame:
    """(pos, code, n, s): how many sequences have each letter (0: a gap) at each position, and the sum of their weights.

    Each task counts its rows; 21 numbers for each position leave it. Sequences of several lengths raise.
    """
    parts = weighted(msa, weights).select("seq", "w").mapInArrow(_letter_batches, "pos int, code int, n long, s double")
    return parts.groupBy("pos", "code").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def by_position(sums: DataFrame) -> DataFrame:
    """(pos, rows, total, of): one row for each position; ``of`` maps letters to their sums. Positions that not all sequences have raise."""
    out = sums.groupBy("pos").agg(F.sum("n").alias("rows"), F.sum("s").alias("total"), F.map_from_entries(F.collect_list(F.struct("code", "s"))).alias("of"))
    most = out.agg(F.max("rows").alias("_most"))
    checked = F.when(F.col("rows") == F.col("_most"), F.col("rows")).otherwise(F.raise_error(F.lit("sequences have several lengths; an alignment needs one")))
    return out.crossJoin(F.broadcast(most)).select("pos", checked.cast("long").alias("rows"), "total", "of")


@dataclass
class Counts:
    """Columns, rows and sum of weights of an alignment, and the weighted counts (positions, LETTERS) of its letters."""

    length: int
    rows: int
    total: float
    letters: np.ndarray


def collected(msa: DataFrame, weights: DataFrame | Column | None = None) -> Counts:
    """21 numbers for each column of the alignment come to the driver, whatever its number of rows."""
    found = letter_sums(msa, weights).collect()
    if not found:
        return Counts(0, 0, 1.0, np.zeros((0, LETTERS)))
    length = 1 + max(r["pos"] for r in found)
    rows, sums = np.zeros(length, np.int64), np.zeros((length, LETTERS + 1))
    for r in found:
        rows[r["pos"]] += r["n"]
        sums[r["pos"], r["code"]] = r["s"]
    if (rows != rows[0]).any():
        raise ValueError("sequences have several lengths; an alignment needs one")
    return Counts(length, int(rows[0]), float(sums[0].sum()) or 1.0, sums[:, 1:])
