"""Removal of 100-byte strings that also start earlier, by a sparse, distributed suffix array.

Sorting all suffixes of a corpus would shuffle every byte a hundred times. Two strings of
``LENGTH`` bytes can only be equal if their *minimizers* are: the leftmost smallest hash among the
``GRAM``-byte strings inside. So suffixes are needed at minimizer positions alone, one for about
every 35 bytes:

1. Every text is cut into runs of consecutive start positions with the same minimizer. A run is a
   row (gram hash, doc, place); its *context* is all bytes that its windows touch.
2. Runs whose gram occurs once in the corpus repeat nothing and go. The contexts of the others are sorted
   deep-shallow (Manzini, Ferragina 2004): multikey quicksort over 8-byte characters to ``SHALLOW`` bytes, then a
   blind trie for each group that is still tied. The common prefixes of neighbours, to the right of the gram
   and (reversed) to the left of it, split each window length into classes of equal strings; all
   but the first place of a class repeat. Bytes are compared, never hashes.
3. This happens twice. First inside slices of a few MB where the texts are read: a context of which every window has
   an earlier equal one in the slice goes no further, so that a line of the whole corpus leaves a slice once. Then among
   what the slices have left, gram by gram.

Where a slice or a gram has more than ``MANY`` contexts (long runs of one character, boilerplate), equal ones are
merged before the sort. Grams with more than ``WIDE`` contexts left are not sorted in one task: Spark groups their windows, by all of
their bytes, and finds the earliest place of each by a minimum with map-side combining.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covarium.functions.numbering import numbered
from covarium.llm import shared
from covarium.llm.shared import Rolling, cut, mix64

LENGTH = 100
GRAM = 32
SPREAD = LENGTH - GRAM + 1
SHALLOW = 48
WIDE = 20_000
MANY = 256
PIECE = 1 << 19
TOGETHER = 8 * PIECE

_GRAMS = Rolling(101)


def _pieces(offsets: np.ndarray):
    """Row ranges of up to PIECE bytes; a longer row comes in pieces that share LENGTH - 1 bytes."""
    for a, b in shared.row_chunks(offsets, PIECE):
        size = offsets[b] - offsets[a]
        if size <= 2 * PIECE:
            yield a, b, 0, int(size)
        else:
            for start in range(0, int(size) - LENGTH + 1, PIECE):
                yield a, b, start, min(start + PIECE + LENGTH - 1, int(size))


def runs(data: np.ndarray, offsets: np.ndarray):
    """Runs of window starts with one minimizer: row, first start, last start, gram start and gram hash."""
    n = len(data)
    if n < LENGTH:
        return None
    sums = _GRAMS.prefix(data)
    grams = mix64(_GRAMS.windows(sums, GRAM))
    key = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= SPREAD:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[: n - LENGTH + 1], key[SPREAD - span :])
    least = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    p = np.arange(len(least))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    valid = p + LENGTH <= offsets[1:][row]
    p, row, least = p[valid], row[valid], least[valid]
    if not len(p):
        return None
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(p) - 1]])
    lo, hi, at, row = p[first], p[last], least[first], row[first]
    return row, lo, hi, at, grams[at]


def _run_batches(batches):
    """Rows (gram, doc, place, again): runs that have something first in their slice, and what repeats inside the slice."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = shared.utf8(batch.column(1))
        parts, held = [], 0
        for a, b, start, stop in _pieces(offsets):
            base = offsets[a] + start
            inner = np.clip(offsets[a : b + 1] - base, 0, stop - start)
            if (found := runs(data[base : base + stop - start], inner)) is not None:
                row, lo, hi, at, gram = found
                shift = base - offsets[a + row]
                parts.append((gram, ids[a + row], lo + shift, hi + shift, at + shift, lo + base))
            held += stop - start
            if held >= TOGETHER:
                yield from _slice_runs(parts, data)
                parts, held = [], 0
        yield from _slice_runs(parts, data)


def _slice_runs(parts: list[tuple], data: np.ndarray):
    """The rows of one slice; ``data`` holds its bytes."""
    if not parts:
        return
    gram, doc, lo, hi, at, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, doc, gram))
    gram, doc, lo, hi, at, start = (x[order] for x in (gram, doc, lo, hi, at, start))
    same = gram[1:] == gram[:-1]
    several = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    goes_on = np.ones(len(gram), bool)
    raw = memoryview(data)
    stop = start + (hi - lo) + LENGTH
    intervals = []
    for some in _whole_grams(gram[several]):
        k = several[some]
        d, s, e, whole = repeats_of(gram[k], doc[k], lo[k], hi[k], at[k], [bytes(raw[x:y]) for x, y in zip(start[k].tolist(), stop[k].tolist(), strict=True)])
        goes_on[k[whole]] = False
        intervals.append((d, s, e))
    d, s, e = (np.concatenate(x) for x in zip(*intervals, strict=True)) if intervals else (np.zeros(0, np.int64),) * 3
    s, e, d = _merge(d, s, e)
    if len(d) and (e - s).max() > PIECE:  # a place holds 24 bits
        parts_of = -(-(e - s - LENGTH + 1) // PIECE)
        k = np.repeat(np.arange(len(d)), parts_of)
        s2 = s[k] + (np.arange(len(k)) - np.repeat(np.cumsum(parts_of) - parts_of, parts_of)) * PIECE
        s, e, d = s2, np.minimum(s2 + PIECE + LENGTH - 1, e[k]), d[k]
    spread = mix64(d.astype(np.uint64) + np.uint64(99))
    n = int(goes_on.sum())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([gram[goes_on], spread]).view(np.int64)),
            pa.array(np.concatenate([doc[goes_on], d]), pa.int64()),
            pa.array(np.concatenate([_place(lo, hi, at)[goes_on], _place(s, e - LENGTH, s)])),
            pa.array(np.arange(n + len(d)) >= n),
        ],
        ["gram", "doc_id", "place", "again"],
    )


def _whole_grams(gram: np.ndarray):
    """Ranges of whole grams, about WIDE rows at a time; ``gram`` is sorted."""
    cuts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    a = 0
    while a < len(gram):
        later = cuts[np.searchsorted(cuts, a + WIDE) :]
        b = int(later[0]) if len(later) else len(gram)
        yield np.arange(a, b)
        a = b


def _place(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First start, number of further starts and gram offset in one number: 32, 24 and 7 bits."""
    return (lo.astype(np.int64) << 31) | ((hi - lo).astype(np.int64) << 7) | (at - lo).astype(np.int64)


def _placed(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = place >> 31
    return lo, lo + ((place >> 7) & ((1 << 24) - 1)), lo + (place & 127)


def _merge(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Unions of overlapping or touching intervals of each document."""
    if not len(doc):
        return start, stop, doc
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    lift = group * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + lift)
    new = np.concatenate([[True], (start + lift)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return start[first], reach[last] - lift[last], doc[first]


# --- deep-shallow sorting --------------------------------------------------------------------------


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """A compacted trie that stores branch depths only; strings are compared once per insertion."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | int | None = None

    @staticmethod
    def _char(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        """Nodes are [depth, {char: child}]; leaves are lists of equal strings' numbers under key None."""
        s = self.strings[i]
        if self.root is None:
            self.root = (len(s), [i])
            return
        node = self.root
        while isinstance(node, list):
            children = node[1]
            node = children.get(self._char(s, node[0])) or next(iter(children.values()))
        other = self.strings[node[1][0]]
        common = _common(s, other)
        if common == len(s) == len(other):
            node[1].append(i)
            return
        parent, node, edge = None, self.root, None
        while isinstance(node, list) and node[0] < common:
            edge = self._char(s, node[0])
            parent, node = node, node[1][edge]
        if isinstance(node, list) and node[0] == common:
            node[1][self._char(s, common)] = (len(s), [i])
            return
        fork = [common, {self._char(other, common): node, self._char(s, common): (len(s), [i])}]
        if parent is None:
            self.root = fork
        else:
            parent[1][edge] = fork

    def walk(self) -> tuple[list[int], list[int]]:
        """Numbers in sorted order, and the common prefix of each with the one before (the first: 0)."""
        order: list[int] = []
        common: list[int] = []
        stack = [(self.root, 0)]
        while stack:
            node, shared_with_last = stack.pop()
            if isinstance(node, list):
                keys = sorted(node[1])
                stack.extend((node[1][c], node[0]) for c in keys[:0:-1])
                stack.append((node[1][keys[0]], shared_with_last))
            elif node is not None:
                order.extend(node[1])
                common.extend([shared_with_last] + [node[0]] * (len(node[1]) - 1))
        return order, common


def multikey_quicksort(characters: np.ndarray) -> np.ndarray:
    """The order of the rows of ``characters`` (n, depth), after Bentley and Sedgewick (1997).

    A segment is split by the middle row's character at the segment's depth into smaller, equal and larger ones; the equal
    ones go on with the next character. All open segments are split in the same step; each row's new place follows from counts.
    """
    n, depth = characters.shape
    order = np.arange(n)
    start, size, level = np.array([0]), np.array([n]), np.array([0])  # open segments
    while len(start):
        open_ = (size > 1) & (level < depth)
        start, size, level = start[open_], size[open_], level[open_]
        if not len(start):
            break
        first = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(segment)) - first[segment] + start[segment]
        row = order[place]
        own = characters[row, level[segment]]
        pivot = own[first + size // 2][segment]
        side = (own > pivot).astype(np.int64) - (own < pivot) + 1
        count = np.bincount(segment * 3 + side, minlength=3 * len(size)).reshape(-1, 3)
        lead = start[:, None] + np.cumsum(count, axis=1) - count
        new = np.empty_like(place)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            before = np.cumsum(count[:, k]) - count[:, k]
            new[mine] = lead[segment[mine], k] + np.arange(len(mine)) - before[segment[mine]]
        order[new] = row
        start, size = lead.ravel(), count.ravel()
        level = (level[:, None] + np.array([0, 1, 0])).ravel()
    return order


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte strings and the common prefix length of each with its predecessor.

    Shallow: multikey quicksort over 8-byte characters down to SHALLOW bytes. Deep: a blind trie for each group still tied there.
    """
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.frombuffer(b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings]), np.uint8).reshape(n, SHALLOW)
    order = multikey_quicksort(head.view(">u8").astype(np.uint64))
    differ = head[order][1:] != head[order][:-1]
    tied = np.concatenate([[False], ~differ.any(axis=1)])
    common = np.concatenate([[0], differ.argmax(axis=1)])
    first = np.flatnonzero(~tied)
    last = np.concatenate([first[1:], [n]])
    some = last - first > 1
    for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True):
        if b - a == 2:  # one branch
            x, y = strings[order[a]], strings[order[a + 1]]
            if x > y:
                order[a], order[a + 1] = order[a + 1], order[a]
            common[a + 1] = _common(x, y)
            continue
        trie = BlindTrie(strings)
        for i in order[a:b].tolist():
            trie.insert(i)
        order[a:b], inner = trie.walk()
        common[a + 1 : b] = inner[1:]
    return order, common


def _ranks(strings: list[bytes]):
    order, common = deep_shallow(strings)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, common


def repeats(doc, lo, hi, at, contexts: list[bytes]):
    """Least and most distance left of the gram (most < 0: none) of the windows that also start earlier, and how many they are.

    The arrays hold whole grams and are ordered by (doc, at); contexts[i] holds the bytes from lo to hi + LENGTH.
    """
    left = at - lo
    least, most = at - hi, left  # how far left of the gram a window starts
    right_place, right_common = _ranks([c[k:] for c, k in zip(contexts, left.tolist(), strict=True)])
    left_place, left_common = _ranks([c[:k][::-1] for c, k in zip(contexts, left.tolist(), strict=True)])
    n = len(doc)
    low, high, times = np.full(n, SPREAD), np.full(n, -1), np.zeros(n, np.int64)
    for o in range(SPREAD):
        act = np.flatnonzero((least <= o) & (o <= most))
        if len(act) < 2:
            continue
        rc = np.cumsum(right_common < LENGTH - o)[right_place[act]]
        # a left string may come from the empty one: at o = 0 all agree
        lc = np.cumsum(left_common < o)[left_place[act]] if o else np.zeros(len(act), np.int64)
        _, first, inverse = np.unique(rc * (n + 1) + lc, return_index=True, return_inverse=True)
        again = act[(doc[act[first]][inverse] != doc[act]) | (at[act[first]][inverse] != at[act])]
        low[again] = np.minimum(low[again], o)
        high[again] = np.maximum(high[again], o)
        times[again] += 1
    return low, high, times


def repeats_of(gram, doc, lo, hi, at, contexts: list[bytes]):
    """Intervals (doc, start, stop) covered by windows that also start earlier, and whether all windows of a row do. Rows are whole grams."""
    order = np.lexsort((at, doc))
    first = order
    count = np.unique(gram, return_inverse=True, return_counts=True)
    if count[2].max() > MANY:  # equal contexts once, at their first place
        seen: dict[tuple, int] = {}
        big = count[2][count[1]] > MANY
        owner = np.arange(len(gram))
        for i in order[big[order]].tolist():
            owner[i] = seen.setdefault((contexts[i], int(at[i] - lo[i])), i)
        first = order[owner[order] == order]
    else:
        owner = np.arange(len(gram))
    low, high, times = np.full(len(gram), 0), np.full(len(gram), -1), np.zeros(len(gram), np.int64)
    low[first], high[first], times[first] = repeats(doc[first], lo[first], hi[first], at[first], [contexts[i] for i in first.tolist()])
    copy = np.flatnonzero((owner != np.arange(len(gram))) & ((doc != doc[owner]) | (at != at[owner])))  # a repeated row is the same place
    low[copy], high[copy], times[copy] = (at - hi)[copy], (at - lo)[copy], (hi - lo)[copy] + 1
    twin = np.flatnonzero((owner != np.arange(len(gram))) & (doc == doc[owner]) & (at == at[owner]))
    low[twin], high[twin], times[twin] = low[owner[twin]], high[owner[twin]], times[owner[twin]]
    hit = np.flatnonzero(high >= 0)
    return doc[hit], (at - high)[hit], (at - low)[hit] + LENGTH, times == hi - lo + 1


def _pack_batches(batches):
    """Texts as compressed bytes: what a join shuffles is then about half."""
    for batch in batches:
        data, offsets = shared.utf8(batch.column(1))
        raw = memoryview(data)
        packed = [_ZSTD.compress(raw[a:b], asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(packed, pa.binary())], ["doc_id", "size", "packed"])


_ZSTD = pa.Codec("zstd", compression_level=3)


def _slices(batches, limit: int = 4 << 20):
    """The batches in parts of about ``limit`` bytes of text."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy())])
        for a, b in shared.row_chunks(at, limit):
            yield batch.slice(a, b - a)


def _unpack(batch) -> list[bytes]:
    size = batch.column("size").to_pylist()
    return [_ZSTD.decompress(z, n, asbytes=True) if n else b"" for z, n in zip(batch.column("packed"), size, strict=True)]


def _context_batches(batches):
    for batch in _slices(batches):
        texts = _unpack(batch)
        places = batch.column("places")
        owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(places).to_numpy(zero_copy_only=False))
        flat = places.flatten()
        lo, hi, _ = _placed(flat.field("place").to_numpy())
        bytes_ = [texts[i][a:b] for i, a, b in zip(owner.tolist(), lo.tolist(), (hi + LENGTH).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([flat.field("gram"), batch.column("doc_id").take(pa.array(owner)), flat.field("place"), pa.array(bytes_, pa.binary())], ["gram", "doc_id", "place", "context"])


def _repeat_batches(batches):
    from covarium.llm.neardup import _groups

    for t in _groups(batches, "gram"):
        gram, doc = t.column("gram").to_numpy(), t.column("doc_id").to_numpy()
        lo, hi, at = _placed(t.column("place").to_numpy())
        for k in _whole_grams(gram):
            a, b = int(k[0]), int(k[-1]) + 1
            d, s, e, _ = repeats_of(gram[a:b], doc[a:b], lo[a:b], hi[a:b], at[a:b], t.column("context").slice(a, b - a).to_pylist())
            s, e, d = _merge(d, s, e)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc_id", "s", "e"])


def _wide_repeats(contexts: DataFrame) -> DataFrame:
    """The same for grams with very many contexts: the earliest place of every window, by grouped minima."""
    lo, more = F.shiftright("place", 31).alias("lo"), F.shiftright("place", 7).bitwiseAND((1 << 24) - 1)
    w = contexts.select("doc_id", lo, (F.shiftright("place", 31) + more).alias("hi"), "context")
    w = w.select("doc_id", F.explode(F.sequence("lo", "hi")).alias("p"), "lo", "context").select("doc_id", "p", F.expr("substring(context, cast(p - lo + 1 as int), 100)").alias("window"))
    first = w.groupBy("window").agg(F.min(F.struct("doc_id", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return w.join(first, "window").where(F.struct("doc_id", "p") != F.col("first")).select("doc_id", F.col("p").cast("int").alias("s"), (F.col("p") + LENGTH).cast("int").alias("e"))


def _keep_batches(batches):
    for batch in _slices(batches):
        ids = batch.column("doc_id")
        rows = []
        for text, own in zip(_unpack(batch), batch.column("cuts").to_pylist(), strict=True):
            spans: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in own or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            edges = [0, *(x for span in spans for x in span), len(text)]
            kept = b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), [{"s": s, "e": e} for s, e in spans]))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans)``.

    Every byte covered by a 100-byte string that also starts earlier (at a smaller doc_id, or in
    the same document at an earlier byte) is removed, judged on the input. ``spans`` are the maximal
    removed runs of bytes, ``kept_text`` the remaining bytes as text (a cut inside a character shows
    as U+FFFD; ``kept_sha256`` is of the exact bytes). Null and empty texts, and texts under 100
    bytes, lose nothing, nor do rows without doc_id, which are no place for others either. Texts of
    any length are cut into overlapping pieces. Rows that repeat wholly are one place and give equal
    rows; of different texts under one doc_id that with the smaller xxhash64 is the earlier document. Extra columns are ignored; an
    empty table gives an empty one.
    """
    docs = shared.only(docs, "doc_id", "text")
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("_text"))
    several = texts.groupBy("doc_id").agg(F.min("_text").alias("low"), F.max("_text").alias("high")).where("low <> high").select("doc_id")
    if several.isEmpty():
        return _without_repeats(docs)
    # where documents share an id, all get numbers of their own, in the same order
    numbers = numbered(texts.distinct(), ["doc_id", "_text"], "_number")
    keyed = docs.withColumn("_text", F.xxhash64("text")).join(numbers, ["doc_id", "_text"], "left")
    out = _without_repeats(keyed.select(F.col("_number").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_number")
    return out.join(numbers.select("_number", "doc_id"), "_number", "left").select("doc_id", *[c for c in out.columns if c != "_number"])


def _without_repeats(docs: DataFrame) -> DataFrame:
    """The same of documents with ids of their own."""
    found = docs.where("doc_id is not null").mapInArrow(_run_batches, "gram long, doc_id long, place long, again boolean")
    times = F.count("*").over(Window.partitionBy("gram"))
    seen = shared.written(found.withColumn("times", times).where("again or times > 1").drop("times"))
    start = F.shiftright("place", 31)
    stop = start + F.shiftright("place", 7).bitwiseAND((1 << 24) - 1) + LENGTH
    cuts = seen.where("again").select("doc_id", start.cast("int").alias("s"), stop.cast("int").alias("e"))
    packed = docs.mapInArrow(_pack_batches, "doc_id long, size long, packed binary")

    def contexts(places: DataFrame) -> DataFrame:
        listed = places.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "place")).alias("places"))
        return packed.join(listed, "doc_id").select("doc_id", "size", "packed", "places").mapInArrow(_context_batches, "gram long, doc_id long, place long, context binary")

    unsure = seen.where("not again").select("gram", "doc_id", "place")
    wide = cut(unsure.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > WIDE).select("gram"))
    if not wide.isEmpty():
        cuts = cuts.union(_wide_repeats(contexts(unsure.join(wide, "gram", "left_semi"))))
        unsure = unsure.join(wide, "gram", "left_anti")
    in_order = contexts(unsure).repartition("gram").sortWithinPartitions("gram")
    cuts = cuts.union(in_order.mapInArrow(_repeat_batches, "doc_id long, s int, e int"))
    cuts = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))
    return packed.join(cuts, "doc_id", "left").select("doc_id", "size", "packed", "cuts").mapInArrow(_keep_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<s:int,e:int>>")
