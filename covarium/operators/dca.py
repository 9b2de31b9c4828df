"""Direct information between positions, from the inverse of the letter correlations.

The correlations are a matrix of 20 rows a position, held as a table of strips of whole rows. It is inverted in place, strip by
strip (Gauss and Jordan by blocks): the rows of one strip are solved with its own corner and go to all others, which are
updated where they are. No task holds more than two strips, and the driver none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.functions.encode import LETTERS
from covarium.functions.settle import settle
from covarium.operators import freq
from covarium.operators.counts import Counts

#: Bytes of a strip, which also goes to all tasks while it is the pivot.
STRIP_BYTES = 32 << 20
#: Pairs of positions whose fields are found together.
PAIRS = 512


def pair_information(couplings: np.ndarray, fi: np.ndarray, fj: np.ndarray, tolerance: float = 1e-4, rounds: int = 100_000) -> np.ndarray:
    """Direct information of pairs of one position (letter shares ``fi``) with others (rows of ``fj``), from (pairs, letters, letters) couplings.

    Couplings e^J with fields set so that both margins are met; the gap is a 21st letter. Every pair ends by itself.
    """
    pairs, wide = len(couplings), LETTERS + 1
    w = np.ones((pairs, wide, wide))
    w[:, :LETTERS, :LETTERS] = np.exp(couplings)
    pi = np.append(fi, max(1 - fi.sum(), 0))
    pj = np.concatenate([fj, np.maximum(1 - fj.sum(axis=1, keepdims=True), 0)], axis=1)
    a, b = np.full((pairs, wide), 1.0 / wide), np.full((pairs, wide), 1.0 / wide)
    open_ = np.arange(pairs)
    for _ in range(rounds):
        part = w[open_]
        new_a = pi / np.matmul(part, b[open_][:, :, None])[:, :, 0]
        new_a /= new_a.sum(axis=1, keepdims=True)
        new_b = pj[open_] / np.matmul(new_a[:, None, :], part)[:, 0, :]
        new_b /= new_b.sum(axis=1, keepdims=True)
        moved = np.maximum(np.abs(new_a - a[open_]).max(axis=1), np.abs(new_b - b[open_]).max(axis=1))
        a[open_], b[open_] = new_a, new_b
        open_ = open_[moved >= tolerance]
        if not len(open_):
            break
    p = w * a[:, :, None] * b[:, None, :]
    p /= p.sum(axis=(1, 2), keepdims=True)
    tiny = 1e-100
    return (p * np.log((p + tiny) / (pi[None, :, None] * pj[:, None, :] + tiny))).sum(axis=(1, 2))


def strips_of(parts: DataFrame, counts: Counts, per: int, regularise: float) -> DataFrame:
    """(strip, block): the rows of ``per`` positions of the regularised correlations, from ``parts(i, block)`` of their upper half."""
    length, total, n = counts.length, counts.total, counts.length * LETTERS
    f1, q, size = (counts.letters / counts.total).ravel(), freq.UNIFORM, per * LETTERS

    def split(t: pa.Table) -> pa.Table:
        i = t.column("i")[0].as_py()
        row = sum((np.frombuffer(b.as_buffer()) for b in t.column("block")), np.zeros(LETTERS * n)).reshape(LETTERS, n) / total
        row[:, : i * LETTERS] = 0  # not filled in
        beyond = row.copy()
        beyond[:, : (i + 1) * LETTERS] = 0
        own = i // per
        out = [(own, i, -1, row.tobytes())]
        out += [(s, i, s, beyond[:, s * size : (s + 1) * size].tobytes()) for s in range(own, math.ceil(length / per))]
        return pa.table({k: pa.array([r[c] for r in out], kind) for c, (k, kind) in enumerate((("strip", pa.int32()), ("i", pa.int32()), ("turned", pa.int32()), ("block", pa.binary())))})

    def gather(t: pa.Table) -> pa.Table:
        strip = t.column("strip")[0].as_py()
        first = strip * per
        rows = min(per, length - first) * LETTERS
        out = np.zeros((rows, n))
        for i, turned, block in zip(t.column("i").to_pylist(), t.column("turned").to_pylist(), t.column("block"), strict=True):
            part = np.frombuffer(block.as_buffer()).reshape(LETTERS, -1)
            if turned < 0:
                out[(i - first) * LETTERS : (i - first + 1) * LETTERS] += part
            else:
                out[:, i * LETTERS : (i + 1) * LETTERS] += part.T
        at = np.arange(first * LETTERS, first * LETTERS + rows)
        out = (1 - regularise) * (out - np.outer(f1[at], f1))
        for k in range(rows // LETTERS):
            here = slice((first + k) * LETTERS, (first + k + 1) * LETTERS)
            out[k * LETTERS : (k + 1) * LETTERS, here] += regularise * (np.eye(LETTERS) * q - q * q)
        return pa.table({"strip": pa.array([strip], pa.int32()), "block": pa.array([out.tobytes()], pa.binary())})

    pieces = parts.groupBy("i").applyInArrow(split, "strip int, i int, turned int, block binary")
    return pieces.groupBy("strip").applyInArrow(gather, "strip int, block binary")


def inverse(strips: DataFrame, n: int, size: int) -> DataFrame:
    """(strip, block) of the inverse of a symmetric, positive definite matrix of n rows, in strips of ``size`` rows."""
    corner = lambda k: slice(k * size, min((k + 1) * size, n))
    strips = settle(strips)
    for k in range(math.ceil(n / size)):

        def solve(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(0):
                    rows = np.frombuffer(block.as_buffer()).reshape(-1, n).copy()
                    own = np.linalg.inv(rows[:, corner(k)])
                    rows = own @ rows
                    rows[:, corner(k)] = own
                    yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["pivot"])

        def update(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for strip, block, pivot in zip(*batch.columns, strict=True):
                    if strip.as_py() == k:
                        new = pivot.as_py()
                    else:
                        rows = np.frombuffer(block.as_buffer()).reshape(-1, n).copy()
                        by = rows[:, corner(k)].copy()
                        rows[:, corner(k)] = 0
                        rows -= by @ np.frombuffer(pivot.as_buffer()).reshape(-1, n)
                        new = rows.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([strip.as_py()], pa.int32()), pa.array([new], pa.binary())], ["strip", "block"])

        pivot = strips.where(F.col("strip") == k).select("block").mapInArrow(solve, "pivot binary")  # one row of STRIP_BYTES
        strips = settle(strips.crossJoin(F.broadcast(pivot)).mapInArrow(update, "strip int, block binary"))
    return strips


def direct_information(msa: DataFrame, weights: DataFrame | None = None, regularise: float = 0.5) -> DataFrame:
    """(i, j, di), i < j, for any number of positions."""
    counts = freq.collected(msa, weights)
    length, n = counts.length, counts.length * LETTERS
    per = max(1, min(length, STRIP_BYTES // max(1, LETTERS * n * 8)))
    schema = "i int, j int, di double"
    if length < 2:
        return msa.sparkSession.createDataFrame([], schema)
    inverted = inverse(strips_of(freq._gram_parts(msa, weights, counts), counts, per, regularise), n, per * LETTERS)
    f = (1 - regularise) * counts.letters / counts.total + regularise * freq.UNIFORM

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strip, block in zip(*batch.columns, strict=True):
                rows = np.frombuffer(block.as_buffer()).reshape(-1, LETTERS * n)
                for k, row in enumerate(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([strip.as_py() * per + k], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["i", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                couplings = -np.frombuffer(row.as_buffer()).reshape(LETTERS, length, LETTERS).transpose(1, 0, 2)
                for a in range(i + 1, length, PAIRS):
                    js = np.arange(a, min(a + PAIRS, length))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(js), i, np.int32)), pa.array(js.astype(np.int32)), pa.array(pair_information(couplings[js], f[i], f[js]))], ["i", "j", "di"])

    return inverted.mapInArrow(rows_of, "i int, row binary").repartition(max(1, min(length, 4_096)), "i").mapInArrow(run, schema)
