"""MinHash near-duplicates with odd sketches, exact on full shingle sets.

1. Each text becomes its set of 5-word shingles (48-bit hashes), a MinHash sketch of
   ``BANDS * ROWS`` bins and an odd sketch: every (bin, minimum) flips one bit of a 1,024-bit
   parity map, so that the population count of two maps' XOR estimates the sets' similarity
   (Mitzenmacher, Pagh, Pham 2014). Bins are filled by "fast similarity sketching" (Dahlgaard,
   Knudsen, Thorup 2017), whose cost is that of a few hashes a shingle instead of one per bin.
2. Equal sets are one class from here on: copies are never paired with each other.
3. Band keys make buckets. Round one pairs each member of a bucket with two leaders, its smallest id
   and its hub (two stars: twice as many pairs as members); pairs whose odd sketches allow the
   threshold are confirmed on both full sets, and components follow from the links.
4. Round two compares, in blocks of bounded size, the members that round one left in different
   components, each pair in the first bucket that both share. Odd sketches come first there too, full
   sets decide, and a block gives at most one link less than it has members: a bucket of any
   size is compared wholly, but no group's pairs are written out.

A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: at 0.75 all but
3 in ten million pairs, above it fewer still. The odd-sketch filter lies 0.17 below the threshold, more than
six standard errors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covarium.llm import shared
from covarium.llm.components import stars
from covarium.llm.shared import cut, list_array, mix64, written

SHINGLE_WORDS = 5
ROWS, BANDS = 5, 56
BINS = ROWS * BANDS
SKETCH_BITS = 1024
ROUNDS = 12
LOOSE = 0.17
BLOCK = 512
SHINGLES_A_PART = 2_000_000

_META = "doc_id long, text_hash long, n long, s1 long, s2 long, bands array<long>, odd array<long>"


def minhash(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """The (rows, BINS) sketch of sets given as sorted (row, hash); rows without elements stay at the maximum.

    Round i deals each element to one bin; a bin keeps the element of its earliest round, and there
    the smallest value. What ROUNDS rounds leave empty (small sets) is filled by hashing all
    elements for each bin.
    """
    top = np.iinfo(np.uint64).max
    sketch = np.full(rows * BINS, top, np.uint64)
    left_r, left_h = row, h
    for i in range(ROUNDS):
        if not len(left_h):
            break
        x = mix64(left_h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = left_r * BINS + (x % np.uint64(BINS)).astype(np.int64)
        np.minimum.at(sketch, at, (x >> np.uint64(8)) | np.uint64(i << 56))
        gaps = (sketch.reshape(rows, BINS) == top).any(axis=1)
        keep = gaps[left_r]
        left_r, left_h = left_r[keep], left_h[keep]
    grid = sketch.reshape(rows, BINS)
    if len(left_h):
        salts = mix64(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        bounds = np.flatnonzero(np.concatenate([[True], left_r[1:] != left_r[:-1], [True]]))
        a = 0
        while a < len(bounds) - 1:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 2048, side="right")) - 1)
            piece, who = left_h[bounds[a] : bounds[b]], left_r[bounds[a:b]]
            least = np.minimum.reduceat(mix64(piece[:, None] + salts[None, :]) >> np.uint64(8), bounds[a:b] - bounds[a], axis=0)
            old = grid[who]
            grid[who] = np.where(old == top, least | np.uint64(ROUNDS << 56), old)
            a = b
    return grid


def odd_sketch(grid: np.ndarray) -> np.ndarray:
    """Parity maps (rows, SKETCH_BITS / 64) of the MinHash samples."""
    rows = len(grid)
    bit = mix64(grid + np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - int(math.log2(SKETCH_BITS)))
    parity = np.zeros(rows * SKETCH_BITS, np.uint8)
    flat = (bit.astype(np.int64) + np.arange(rows)[:, None] * SKETCH_BITS).ravel()
    parity += (np.bincount(flat, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(rows, SKETCH_BITS), axis=1).view(np.uint64)


def odd_similarity(differing_bits: np.ndarray | float) -> np.ndarray | float:
    """Similarity that an XOR population count stands for."""
    return 1 + SKETCH_BITS / (4 * BINS) * np.log(np.maximum(1 - 2 * np.asarray(differing_bits) / SKETCH_BITS, 1e-9))


def most_differing(similarity: float) -> int:
    """The XOR population count at which the estimate falls to ``similarity``."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp((similarity - 1) * 4 * BINS / SKETCH_BITS)))


def _sketch_batches(batches):
    for batch in batches:
        data, offsets = shared.utf8(batch.column(1))
        for a, b in shared.row_chunks(offsets):
            part = data[offsets[a] : offsets[b]]
            _, _, row, hashes = shared.words(part, offsets[a : b + 1] - offsets[a])
            row, h = shared.shingles(hashes, row, b - a, SHINGLE_WORDS)
            n = np.bincount(row, minlength=b - a)
            sums = []
            for salt in (0x1234567, 0x89ABCDE):
                s = np.zeros(b - a, np.uint64)
                np.add.at(s, row, mix64(h + np.uint64(salt)))
                sums.append(pa.array(s.view(np.int64)))
            grid = minhash(row, h, b - a)
            key = np.zeros((b - a, BANDS), np.uint64)
            for j in range(ROWS):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, j::ROWS])
            key = mix64(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            some = n > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(2).slice(a, b - a),
                    pa.array(n.astype(np.int64)),
                    *sums,
                    list_array(key[some].ravel().view(np.int64), BANDS * some, pa.int64()),
                    list_array(odd_sketch(grid)[some].ravel().view(np.int64), SKETCH_BITS // 64 * some, pa.int64()),
                ],
                ["doc_id", "text_hash", "n", "s1", "s2", "bands", "odd"],
            )


def _set_batches(batches):
    """The columns but the last, the text, and the text's set."""
    for batch in batches:
        data, offsets = shared.utf8(batch.column(batch.num_columns - 1))
        for a, b in shared.row_chunks(offsets):
            _, _, row, hashes = shared.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            row, h = shared.shingles(hashes, row, b - a, SHINGLE_WORDS)
            own = list_array(h.view(np.int64), np.bincount(row, minlength=b - a), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), own], [*batch.schema.names[:-1], "set"])


def _groups(batches, key: str):
    """Whole groups of consecutive rows with equal ``key``, as Arrow tables holding one or more groups each."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = t.column(key).to_numpy()
        last = np.flatnonzero(k[1:] != k[:-1])
        if not len(last):
            if held and held[-1].column(key)[-1].as_py() != k[0]:
                yield pa.concat_tables(held)
                held = []
            held.append(t)
            continue
        split = int(last[-1]) + 1
        yield pa.concat_tables([*held, t.slice(0, split)])
        held = [t.slice(split)]
    if held:
        yield pa.concat_tables(held)


class _Sets:
    """Members of one block, and the exact test of one against several others."""

    def __init__(self, flat: np.ndarray, at: np.ndarray) -> None:
        self.flat, self.at = flat, at

    def shared_with(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set x with each of the others; sets are sorted and not empty."""
        own = self.flat[self.at[x] : self.at[x + 1]]
        size = self.at[others + 1] - self.at[others]
        edge = np.cumsum(size) - size
        take = np.repeat(self.at[others] - edge, size) + np.arange(int(size.sum()))
        theirs = self.flat[take]
        place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        return np.add.reduceat((own[place] == theirs).astype(np.int64), edge)


def _block_links(percent: int):
    """Links between different components in each block; a link that joins nothing new in its block is left out."""
    threshold = percent / 100
    most = most_differing(threshold - LOOSE)

    def block(ids, comp, n, side, keys, odd, bands, sets, a, b):
        root = {c: c for c in comp[a:b].tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        rows = np.arange(a, b)
        # side 0: pairs within one part; 1 and 2: pairs between the two parts
        right = rows[side[a:b] != 1]
        for x in rows[side[a:b] != 2].tolist():
            y = right[(comp[right] != comp[x]) & (n[right] >= threshold * n[x]) & (n[x] >= threshold * n[right])]
            if side[a] == 0:
                y = y[ids[y] > ids[x]]
            if not len(y):
                continue
            differ = np.bitwise_count(odd[y] ^ odd[x]).sum(axis=1, dtype=np.int64)
            y, differ = y[differ <= most], differ[differ <= most]
            same = bands[y] == bands[x]
            y, differ = (v[bands[x][same.argmax(axis=1)] == keys[a]] for v in (y, differ))  # else another bucket's block has the pair
            y = y[np.argsort(differ, kind="stable")]
            while len(y):
                mine = find(int(comp[x]))
                y = y[[find(c) != mine for c in comp[y].tolist()]]
                now, y = y[:64], y[64:]
                if not len(now):
                    break
                both = sets.shared_with(x, now)
                for z in now[both * 100 >= (n[x] + n[now] - both) * percent].tolist():
                    u, v = find(int(comp[x])), find(int(comp[z]))
                    if u != v:
                        root[u] = v
                        yield min(ids[x], ids[z]), max(ids[x], ids[z])

    def run(batches):
        for t in _groups(batches, "cell"):
            cell, ids, comp, n, side, keys = (t.column(c).to_numpy() for c in ("cell", "id", "component", "n", "side", "key"))
            odd = t.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_BITS // 64)
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            lists = t.column("set").combine_chunks()
            at = lists.offsets.to_numpy().astype(np.int64)
            sets = _Sets(lists.flatten().to_numpy().view(np.uint64), at - at[0])
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])).tolist()
            found = [pair for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1 for pair in block(ids, comp, n, side, keys, odd, bands, sets, a, b)]
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(id, leader)`` whose odd sketches allow the threshold and whose full sets have 100 * intersection >= percent * union."""
    least = percent / 100
    a, b = (sets.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "odd", "set"))) for end in ("id", "leader"))
    bits = F.aggregate(F.zip_with("odd_id", "odd_leader", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.size(F.array_intersect("set_id", "set_leader"))
    close = (F.col("n_id") >= least * F.col("n_leader")) & (F.col("n_leader") >= least * F.col("n_id")) & (bits <= most_differing(least - LOOSE))
    return (
        pairs.join(a, "id")
        .join(b, "leader")
        .where(close & (both * (100 + percent) >= (F.col("n_id") + F.col("n_leader")) * percent))
        .select(F.col("id").alias("u"), F.col("leader").alias("v"))
    )


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets;
    ``component_id`` is the smallest doc_id reachable and ``kept`` marks that document. A null or
    empty text, or one of white space only, has no shingles and is linked with nothing. Texts of one
    to four words have one shingle. Equal texts, repeated rows and ties need nothing special: equal
    sets are one class. Rows without doc_id are linked with nothing, have no component_id, and are
    kept. Different texts under one doc_id are documents of their own, in groups of their own; of those that share the smallest
    doc_id of a component, one set of shingles is kept. Very long texts are read whole; sets are of 48-bit hashes. Extra columns are ignored; an empty table gives an empty one.
    """
    return near_duplicate_texts(docs, percent).drop("text_hash")


def hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_hash``, which tells texts of one doc_id apart."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def near_duplicate_texts(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The same with the ``text_hash`` of each row."""
    texts = hashed(shared.only(docs, "doc_id", "text"))
    meta = cut(texts.mapInArrow(_sketch_batches, _META))
    classes = meta.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "text_hash", "n", "bands", "odd")).alias("m"))
    # a class has a number of its own, since texts of one doc_id can be in several; in the order of doc_id, so that the
    # smallest number of a component is that of its smallest doc_id
    classes = classes.select("s1", "s2", "m.*").orderBy("doc_id", "text_hash", "s1", "s2")
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    member = classes.select("id", "n", F.explode("bands").alias("key"))
    bucket = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    member = written(member.join(bucket, "key").select("id", "n", "key", "m"))

    # Round one: each member with its bucket's smallest id, and with its hub, the member that meets most others.
    degree = F.sum(F.col("m") - 1).over(Window.partitionBy("id"))
    leaders = member.withColumn("degree", degree).groupBy("key").agg(F.min("id").alias("least"), F.max_by("id", F.struct("degree", F.negate("id"))).alias("hub"))
    member = written(member.join(leaders, "key"))
    wanted = classes.join(member.select("id").distinct(), "id", "left_semi").select("doc_id", "text_hash", "id", "n", "odd", "bands")
    sets = texts.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("id", "n", "odd", "bands", "text")
    sets = written(sets.mapInArrow(_set_batches, "id long, n long, odd array<long>, bands array<long>, set array<long>"))
    ends = F.explode(F.array_distinct(F.array("least", "hub"))).alias("leader")
    pairs = member.select("id", ends).where("id <> leader").repartition("id").dropDuplicates(["id", "leader"])
    links = cut(_confirm(pairs, sets, percent))
    tree = stars(links)

    # Round two: in each bucket, members outside the hub's component (side B) with each other and
    # with those inside (side A). Least and hub were compared with all, and A with A is one component.
    placed = member.where("m > 2").join(tree.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left")
    placed = written(placed.select("id", "n", "key", F.coalesce("component", "id").alias("component"), (F.col("id") == F.col("hub")).alias("is_hub"), F.col("id").isin(F.col("hub"), F.col("least")).alias("done")))
    # a part has about BLOCK members at most, and so many shingles that a cell of two parts fits a worker
    parts = placed.groupBy("key", "component").agg(F.sum((~F.col("done")).cast("int")).alias("k"), F.sum(F.when(~F.col("done"), F.col("n")).otherwise(0)).alias("size"), F.max("is_hub").alias("with_hub"))
    sums = [F.sum(F.when(F.col("with_hub") == side, F.col(c)).otherwise(0)).alias(f"{name}_{c}") for side, name in ((True, "a"), (False, "b")) for c in ("k", "size")]
    sizes = parts.groupBy("key").agg(F.max(F.when(F.col("with_hub"), F.col("component"))).alias("hub_component"), *sums).where("b_k > 0 and a_k + b_k > 1")
    parts_b, parts_a = (F.ceil(F.greatest(F.col(f"{side}_k") / BLOCK, F.col(f"{side}_size") / SHINGLES_A_PART)).cast("int") for side in "ba")
    open_ = placed.where("not done").join(sizes, "key").select("id", "key", "component", (F.col("component") != F.col("hub_component")).alias("b"), parts_b.alias("parts_b"), parts_a.alias("parts_a"))
    part = F.pmod(F.xxhash64("id"), F.when(F.col("b"), F.col("parts_b")).otherwise(F.col("parts_a"))).cast("int")
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda x, y, kind, side: F.struct(F.xxhash64("key", x, y, F.lit(kind)).alias("cell"), side.alias("side"))
    among_b = F.transform(up_to(F.col("parts_b")), lambda o: name(F.least("part", o), F.greatest("part", o), "bb", F.when(F.col("part") == o, 0).when(F.col("part") < o, 1).otherwise(2)))
    with_a = F.transform(up_to(F.col("parts_a")), lambda o: name(F.col("part"), o, "ba", F.lit(1)))
    of_a = F.transform(up_to(F.col("parts_b")), lambda o: name(o, F.col("part"), "ba", F.lit(2)))
    cells = (
        open_.withColumn("part", part)
        .select("id", "key", "component", F.explode(F.when(F.col("b"), F.concat(among_b, with_a)).otherwise(of_a)).alias("c"))
        .select("id", "key", "component", "c.cell", "c.side")
    )
    cells = cells.join(sets, "id")
    more = cut(cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_block_links(percent), "u long, v long"))
    if not more.isEmpty():
        tree = stars(tree.union(more))

    # a component is named by its smallest doc_id, that of its smallest class
    roots = classes.select(F.col("id").alias("v"), F.col("doc_id").alias("component_id"))
    named = tree.join(roots, "v").select(F.col("u").alias("id"), "component_id")
    of_class = classes.select("s1", "s2", "id", F.col("doc_id").alias("own")).join(named, "id", "left")
    of_class = of_class.select("s1", "s2", F.coalesce("component_id", "own").alias("component_id"), F.col("component_id").isNull().alias("first"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (
        meta.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "s1", "s2")
        .join(of_class, ["s1", "s2"], "left")
        .select("doc_id", "text_hash", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), (~linked | F.col("first")).alias("first"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("first"))
        .drop("first")
    )
