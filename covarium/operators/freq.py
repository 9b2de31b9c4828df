"""Single and pair frequencies, and the position weights that follow from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions.encode import ALPHABET, BACKGROUND, LETTERS, cells
from covarium.operators.blocks import codes_in, one_hot
from covarium.operators.counts import Counts, by_position, collected, letter_sums, weighted

UNIFORM = 1.0 / (LETTERS + 1)
ROWS_A_GROUP = 50_000
TILE_BYTES = 64 << 20
BATCH_BYTES = 32 << 20
STRIP = 8
FAN = 32


def background_of(code: Column, background: tuple[float, ...] | float = BACKGROUND) -> Column:
    if isinstance(background, float):
        return F.lit(background)
    return F.element_at(F.array(*[F.lit(q) for q in background]), code.cast("int"))


def freq1(msa: DataFrame, weights: DataFrame | Column | None = None, regularise: float = 0.0, background: tuple[float, ...] | float = UNIFORM) -> DataFrame:
    """(pos, code, f), dense: (1 - regularise) * weighted share + regularise * background; gaps count in no letter.

    One pass over the rows. ``weights`` are a table (seq_id, w), or a column of ``msa``, which saves the join.
    """
    grid = by_position(letter_sums(msa, weights)).select("pos", "total", "of", F.explode(F.sequence(F.lit(1), F.lit(LETTERS))).alias("code"))
    share = F.coalesce(F.try_element_at("of", "code") / F.when(F.col("total") != 0, F.col("total")).otherwise(1.0), F.lit(0.0))
    return grid.select("pos", "code", ((1 - regularise) * share + regularise * background_of(F.col("code"), background)).alias("f"))


def freq0(f1: DataFrame) -> DataFrame:
    """(code, f): means over the positions."""
    return f1.groupBy("code").agg(F.avg("f").alias("f"))


def position_weights(f1: DataFrame, background: tuple[float, ...] | float = BACKGROUND) -> DataFrame:
    """(pos, code, f, w, d): |ln of the odds ratio to the background| and relative entropy, each 0 unless 0 < f < 1."""
    f, q = F.col("f"), background_of(F.col("code"), background)
    inside = (f > 0) & (f < 1)
    w = F.abs(F.log(f * (1 - q) / ((1 - f) * q)))
    d = f * F.log(f / q) + (1 - f) * F.log((1 - f) / (1 - q))
    return f1.select("pos", "code", "f", F.when(inside, w).otherwise(0.0).alias("w"), F.when(inside, d).otherwise(0.0).alias("d"))


def conservation(f1: DataFrame, background: tuple[float, ...] | float = BACKGROUND) -> DataFrame:
    """(pos, di): relative entropy of each position with the gap as one more letter, whose background is the overall gap share."""
    n = f1.agg(F.countDistinct("pos").alias("n"), F.sum("f").alias("s")).select((1 - F.col("s") / F.col("n")).alias("t"))
    theta = n.select(F.when(F.col("t") < 1e-12, 0.0).otherwise(F.col("t")).alias("theta"))
    q = background_of(F.col("code"), background)
    part = F.when(F.col("f") > 0, F.col("f") * F.log(F.col("f") / ((1 - F.col("theta")) * q))).otherwise(0.0)
    out = f1.crossJoin(F.broadcast(theta)).groupBy("pos").agg(F.sum(part).alias("letters"), (1 - F.sum("f")).alias("g"), F.first("theta").alias("theta"))
    gap = F.when((F.col("g") > 1e-12) & (F.col("theta") > 0), F.col("g") * F.log(F.col("g") / F.col("theta"))).otherwise(0.0)
    return out.select("pos", (F.col("letters") + gap).alias("di"))


# --- pairs ------------------------------------------------------------------------------------------


def added(parts: DataFrame, by: list[str], groups: int, most: int) -> DataFrame:
    """``parts(by..., part, block)``, part from 0 to groups - 1, with at most ``most`` sums left for each key.

    A level of the tree adds the blocks of at most ``FAN`` consecutive parts in a task.
    """
    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(len(t.column("block")[0].as_buffer()) // 8)
        for b in t.column("block"):
            total += np.frombuffer(b.as_buffer())
        return t.slice(0, 1).set_column(t.schema.get_field_index("block"), "block", pa.array([total.tobytes()], pa.binary()))

    while groups > most:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        parts = parts.groupBy(*by, "part").applyInArrow(add, parts.schema)
        groups = math.ceil(groups / FAN)
    return parts


def tile_of(length: int) -> int:
    """Positions whose sums with all others fit TILE_BYTES."""
    return max(1, min(length, TILE_BYTES // (LETTERS * LETTERS * max(length, 1) * 8)))


def add_products(total: np.ndarray, codes: np.ndarray, w: np.ndarray | None, at: int, stop: int) -> None:
    """Add w * x_i x_j', for positions i from ``at`` to ``stop`` and all j >= i of the strip of i, to ``total``; what lies before stays 0."""
    length = codes.shape[1]
    step = max(64, BATCH_BYTES // (LETTERS * max(length, 1) * 8))
    for a in range(0, len(codes), step):
        x = one_hot(codes[a : a + step], dtype=np.float64)
        for i in range(at, stop, STRIP):
            j = min(i + STRIP, stop)
            own = x[:, i * LETTERS : j * LETTERS]
            total[(i - at) * LETTERS : (j - at) * LETTERS, i * LETTERS :] += (own if w is None else own * w[a : a + step, None]).T @ x[:, i * LETTERS :]


def _gram_parts(msa: DataFrame, weights: DataFrame | Column | None, counts: Counts) -> DataFrame:
    """(i, block): at most FAN partial sums for each position i, over groups of sequences, of w * x_i x_j' with j >= i."""
    length = counts.length
    tile = tile_of(length)
    tiles = math.ceil(max(length, 1) / tile)
    if tiles == 1:
        return _gram_parts_in_place(weighted(msa, weights).select("seq", "w"), length)
    groups = max(1, math.ceil(counts.rows / ROWS_A_GROUP))
    dealt = weighted(msa, weights).select("seq", "w", F.pmod(F.xxhash64("seq_id"), F.lit(groups)).cast("long").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))

    def run(t: pa.Table) -> pa.Table:
        at = t.column("tile")[0].as_py() * tile
        stop = min(at + tile, length)
        total = np.zeros(((stop - at) * LETTERS, length * LETTERS))
        for seq, w in zip(t.column("seq").chunks, t.column("w").chunks, strict=True):
            add_products(total, codes_in(seq), w.to_numpy(), at, stop)
        blocks = [total[k * LETTERS : (k + 1) * LETTERS].tobytes() for k in range(stop - at)]
        part = t.column("part")[0].as_py()
        return pa.table({"i": pa.array(range(at, stop), pa.int32()), "part": pa.array([part] * (stop - at), pa.int64()), "block": pa.array(blocks, pa.binary())})

    return added(dealt.groupBy("part", "tile").applyInArrow(run, "i int, part long, block binary"), ["i"], groups, FAN).select("i", "block")


def _gram_parts_in_place(rows: DataFrame, length: int) -> DataFrame:
    """The same where the sums of all positions fit a task: every task adds its own rows, and only sums are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = np.zeros((length * LETTERS,) * 2) if total is None else total
                add_products(total, codes_in(batch.column(0)), batch.column(1).to_numpy(), 0, length)
        if total is None:
            return
        part = TaskContext.get().partitionId() % (FAN * FAN)
        for k in range(length):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int64()), pa.array([total[k * LETTERS : (k + 1) * LETTERS].tobytes()], pa.binary())], ["i", "part", "block"])

    return added(rows.mapInArrow(run, "i int, part long, block binary"), ["i"], FAN * FAN, FAN).select("i", "block")


def _by_position(parts: DataFrame, counts: Counts, use, schema: str) -> DataFrame:
    """Sum the parts of each position and hand (i, shares) to ``use``; shares with positions before i are not filled in."""
    length, total = counts.length, counts.total

    def run(t: pa.Table) -> pa.Table:
        s = np.zeros(LETTERS * length * LETTERS)
        for b in t.column("block"):
            s += np.frombuffer(b.as_buffer())
        return use(t.column("i")[0].as_py(), s.reshape(LETTERS, length, LETTERS) / total)

    return parts.groupBy("i").applyInArrow(run, schema)


def weights_of(f: np.ndarray) -> np.ndarray:
    """``position_weights`` of an array (positions, LETTERS), under the natural background."""
    q = np.array(BACKGROUND)[None, :]
    ok = (f > 0) & (f < 1)
    safe = np.where(ok, f, 0.5)
    return np.where(ok, np.abs(np.log(safe * (1 - q) / ((1 - safe) * q))), 0.0)


def _pair_background(i: int, length: int, background: np.ndarray) -> np.ndarray:
    out = np.broadcast_to((background[:, None] * background[None, :])[:, None, :], (LETTERS, length, LETTERS)).copy()
    out[:, i, :] = np.diag(background)
    return out


def freq2(msa: DataFrame, weights: DataFrame | Column | None = None, regularise: float = 0.0, background: float = UNIFORM) -> DataFrame:
    """(i, a, j, b, f), i <= j, of all letter pairs with f > 0."""
    counts = collected(msa, weights)
    length, q = counts.length, np.full(LETTERS, background)

    def use(i, f):
        f = (1 - regularise) * f + regularise * _pair_background(i, length, q)
        f[:, :i] = 0  # not filled in
        a, j, b = np.nonzero(f)
        return pa.table({"i": pa.array(np.full(len(a), i, np.int32)), "a": pa.array((a + 1).astype(np.int32)), "j": pa.array(j.astype(np.int32)), "b": pa.array((b + 1).astype(np.int32)), "f": pa.array(f[a, j, b])})

    return _by_position(_gram_parts(msa, weights, counts), counts, use, "i int, a int, j int, b int, f double")


def pair_counts(msa: DataFrame, weights: DataFrame | Column | None = None) -> DataFrame:
    """(i, a, j, b, s), i <= j: the same as a relational join of the cells of each sequence; for few positions."""
    own = cells(weighted(msa, weights))
    left = own.select("seq_id", F.col("pos").alias("i"), F.col("code").alias("a"), "w")
    right = own.select("seq_id", F.col("pos").alias("j"), F.col("code").alias("b"))
    return left.join(right, "seq_id").where("i <= j").groupBy("i", "a", "j", "b").agg(F.sum("w").alias("s"))


def dense(f1: DataFrame, length: int, column: str = "f") -> np.ndarray:
    """(length, LETTERS) array of a table by position and letter: 20 numbers for each column of the alignment."""
    out = np.zeros((length, LETTERS))
    for r in f1.select("pos", "code", column).collect():
        out[r[0], r[1] - 1] = r[2]
    return out


__all__ = ["ALPHABET", "BACKGROUND", "UNIFORM", "conservation", "dense", "freq0", "freq1", "freq2", "pair_counts", "position_weights"]
