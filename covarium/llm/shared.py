"""Helpers that every operator of this package uses."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; where it names none, one of this machine if Spark runs on it alone, else raise."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


#: A cut has at most so many tasks a core, or one for so many bytes of the files that it reads, whichever is more.
TASKS_A_CORE, TASK_BYTES = 4, 16 << 20


def _few_files(df: DataFrame) -> DataFrame:
    """``df`` without very many small tasks, each of which would write a file; tasks are joined only up to about TASK_BYTES of input each.

    As every cut is a table, all that a plan reads comes from files, whose sizes are known.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()) if leaves.apply(k).nodeName().startswith("LogicalRelation"))
    return df.coalesce(max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, min(read // TASK_BYTES, 1 << 30)))


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it from there, which cuts its lineage: compressed, and read by columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    _few_files(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


cut = written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of texts: batches are held outside the heap, several times over, and texts are wide.
BATCH_ROWS = 1_024
BATCH_BYTES = 16 << 20


def narrow_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES; fewer rows stay. Every operator that hands texts to Python does so."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names can't get in the way; for Arrow kernels over texts."""
    narrow_batches(df.sparkSession)
    return df.select(*[F.col(c) for c in columns])


# --- UTF-8 text in Arrow batches -------------------------------------------------------------------


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (n + 1); null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = 1 << 19, rows: int = 8_192):
    """Ranges of whole rows with at most ``limit`` bytes (one longer row stands alone)."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), start + rows, n)
        yield start, stop
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Rolling:
    """Polynomial hashes of byte strings modulo 2**64, with a random value for each byte.

    ``Rolling(seed).prefix(data)`` gives sums from which the hash of any substring follows in O(1).
    """

    def __init__(self, seed: int) -> None:
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 0x9E3779B97F4A7C15))
        self.base = int(mix64(np.array([seed + 77], np.uint64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (self.base, self.inverse))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        own = self.values[data]
        own *= self.up[: len(data)]
        np.cumsum(own, out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (sums[stops] - sums[starts]) * self.down[starts]

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all substrings of length k."""
        return (sums[k:] - sums[:-k]) * self.down[: len(sums) - k]


_WORDS = Rolling(11)


def spans(data: np.ndarray, offsets: np.ndarray):
    """Starts, stops and row of every word ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~_SPACE[data]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Starts, stops, row and 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased)."""
    starts, stops, row = spans(data, offsets)
    if not len(data):
        return starts, stops, row, np.zeros(0, np.uint64)
    sums = _WORDS.prefix(_LOWER[data] if lower else data)
    return starts, stops, row, mix64(_WORDS.of(sums, starts, stops))


_STEP = 0xD6E8FEB86659FD93


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, n: int = 5):
    """Row and 48-bit hash of the distinct n-word shingles of each row, sorted by row and hash.

    A row with 1 to n-1 words has its whole sequence as one shingle; a row without words has none.
    """
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers = [np.uint64(pow(_STEP, j, 1 << 64)) for j in range(n)]
    full = max(len(hashes) - n + 1, 0)
    total = np.zeros(full, np.uint64)
    for j in range(n):
        total += hashes[j : j + full] * powers[j]
    same = row[:full] == row[n - 1 :] if full else np.zeros(0, bool)
    h, r = total[same], row[:full][same]
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(row, short)
        t = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = count[short] > j
            t[has] += hashes[first[has] + j] * powers[j]
        t += count[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        h, r = np.concatenate([h, t]), np.concatenate([r, short])
    key = (r.astype(np.uint64) << np.uint64(48)) | (mix64(h) >> np.uint64(16))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
