"""The position-by-position coupling matrix and the projections that come with it.

Frequencies are regularised towards 1/21 for each letter, weights use the natural background: the two
backgrounds differ on purpose, as in the published method.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions.encode import cells
from covarium.operators import freq

REGULARISE = 0.03


def letter_weights(msa: DataFrame, weights: DataFrame | Column | None = None, regularise: float = REGULARISE) -> DataFrame:
    """(pos, code, w): position weights under the natural background."""
    return freq.position_weights(freq.freq1(msa, weights, regularise, freq.BACKGROUND)).select("pos", "code", "w")


def of_shares(i: int, f: np.ndarray, f1: np.ndarray, w: np.ndarray, regularise: float, norm: str) -> np.ndarray:
    """Couplings of position i to those from i on, from its pair shares (LETTERS, positions, LETTERS), all regularised f1 and weights."""
    length = len(f1)
    f = (1 - regularise) * f + regularise * freq._pair_background(i, length, np.full(freq.LETTERS, freq.UNIFORM))
    c = ((f - f1[i][:, None, None] * f1[None]) * w[i][:, None, None] * w[None])[:, i:].transpose(1, 0, 2)
    return np.sqrt((c**2).sum(axis=(1, 2))) if norm == "frob" else np.linalg.svd(c, compute_uv=False)[:, 0]


def sides(share: np.ndarray, regularise: float) -> tuple[np.ndarray, np.ndarray]:
    """Regularised frequencies and weights from letter shares (positions, LETTERS)."""
    return (1 - regularise) * share + regularise * freq.UNIFORM, freq.weights_of((1 - regularise) * share + regularise * np.array(freq.BACKGROUND)[None, :])


def coupling(msa: DataFrame, weights: DataFrame | Column | None = None, norm: str = "frob", regularise: float = REGULARISE) -> DataFrame:
    """(i, j, c), i <= j: norm of each pair's 20 x 20 block of weighted correlations, Frobenius ("frob") or spectral ("spec").

    Two passes over the rows: letter counts, then pair counts.
    """
    counts = freq.collected(msa, weights)
    length = counts.length
    f1, w = sides(counts.letters / counts.total, regularise)

    def use(i, f):
        return pa.table({"i": pa.array(np.full(length - i, i, np.int32)), "j": pa.array(np.arange(i, length, dtype=np.int32)), "c": pa.array(of_shares(i, f, f1, w, regularise, norm))})

    return freq._by_position(freq._gram_parts(msa, weights, counts), counts, use, "i int, j int, c double")


def projector(msa: DataFrame, weights: DataFrame | Column | None = None, regularise: float = REGULARISE) -> DataFrame:
    """(pos, code, p): weight times frequency of each letter, of length 1 at each position."""
    natural = freq.freq1(msa, weights, regularise, freq.BACKGROUND)
    f = F.col("f") - regularise * freq.background_of(F.col("code")) + regularise * freq.UNIFORM  # the other background, from the same counts
    p = freq.position_weights(natural).select("pos", "code", (f * F.col("w")).alias("p"))
    norm = p.groupBy("pos").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("n"))
    return p.join(norm, "pos").select("pos", "code", F.when(F.col("n") > 0, F.col("p") / F.col("n")).otherwise(0.0).alias("p"))


def project(msa: DataFrame, proj: DataFrame) -> DataFrame:
    """(seq_id, pos, x): each sequence, of this or another alignment, under the projector; gaps have no row (0)."""
    return cells(msa.select("seq_id", "seq")).join(F.broadcast(proj), ["pos", "code"]).select("seq_id", "pos", F.col("p").alias("x"))


def truncate_diagonal(matrix: DataFrame, distance: int) -> DataFrame:
    """Couplings of positions at most ``distance`` apart become 0."""
    return matrix.withColumn("c", F.when(F.abs(F.col("i") - F.col("j")) <= distance, 0.0).otherwise(F.col("c")))


def submatrix(matrix: DataFrame, order: DataFrame) -> DataFrame:
    """(a, b, c) for the positions of ``order(rank, pos)``, by rank on both axes."""
    both = matrix.unionByName(matrix.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    left = order.select(F.col("rank").alias("a"), F.col("pos").alias("i"))
    right = order.select(F.col("rank").alias("b"), F.col("pos").alias("j"))
    return both.join(F.broadcast(left), "i").join(F.broadcast(right), "j").select("a", "b", "c")


def to_matrix(matrix: DataFrame, length: int) -> np.ndarray:
    """The symmetric matrix on the driver: a number for each pair of columns of the alignment, none for its rows."""
    out = np.zeros((length, length))
    pdf = matrix.select("i", "j", "c").toPandas()
    out[pdf.i, pdf.j] = pdf.c
    out[pdf.j, pdf.i] = pdf.c
    return out
