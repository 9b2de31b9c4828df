"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over the whole corpus. All other words weigh
   as much as the median word of the benchmark, whatever the size of the corpus.
2. Randomised SVDs (Halko, Martinsson, Tropp 2011) of TF-IDF passages give the latent space; their products run
   over the partitions of the passages, and only (words x rank) sums come back. Two are of all corpus passages (each WINDOW words of
   each document), in the same passes. The first is of the benchmark's words: its leading axes are those of frequent words, and what a
   benchmark passage has along them is damped. The second is of all words that ``SHARE`` of all passages have: words that stand in the same
   contexts have like rows on its ``MEANING`` axes. A word that the benchmark lacks takes the place of the benchmark word whose row
   is most like its own, from ``ALIKE`` on and by that much, so that a window of other words for the same things comes near the passage.
   A third SVD is of the damped benchmark passages. Every ``RANK`` of them have a space of their own, with as many axes as
   passages, so that a space keeps its passages whole whatever the size of the benchmark.
3. Every window of every document is projected, and its cosine to every passage taken, in blocks. The
   norm of a window counts all its words, so that what lies outside the space lowers the cosine; windows whose words
   can't reach the threshold, by the most that each adds to any passage of a group, are passed over, which loses nothing.
4. A candidate's surroundings and the item are compared by longest common subsequence of words. From
   ``SURE`` of the item's words on, the document leaks it; from ``PARAPHRASE`` on only if the item's answer
   (its last sentence) is there as well.

Items of fewer than ``SHORT`` words are too light in a window of 48 for a cosine. They are looked up exactly: by
their rarest word, then word by word, and leak where all their words stand in a row.

The benchmark is a stated query set and goes to all tasks; ``MOST_WORDS`` bounds its size, above which
it is searched in parts.
"""

from __future__ import annotations

import math
from itertools import chain
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm import shared
from covarium.llm.shared import cut, mix64

HALF = 24
WINDOW = 2 * HALF
RANK = 128
POWER_ROUNDS = 2
SHORT = 12
CORPUS_AXES, DAMP = 16, 0.5
MEANING, LEAST, SHARE, ALIKE = 64, 4, 0.002, 0.7
CORPUS_PRODUCTS = 2
CHUNK, GROUP, BLOCK = 1 << 19, 1 << 20, 1 << 16
ADDENDS = 64
GROUPS = 16
COSINE = 0.3
SURE, PARAPHRASE, ANSWER = 0.7, 0.5, 0.6
MOST_WORDS = 200_000
COUNT_BLOCK = 4_096


@dataclass
class Items:
    """Benchmark items: ids, word hashes, answer word hashes; passages as (item, term, weight) lists."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray

    @classmethod
    def read(cls, rows: list[tuple[int, str]]) -> Items:
        ids, words, answers = [], [], []
        for item_id, text in rows:
            own = _hashes(text or "")
            if not len(own):
                continue
            sentences = [s for s in (text or "").replace("\n", " ").split(". ") if s.strip(" .")]
            ids.append(item_id)
            words.append(own)
            answers.append(_hashes(sentences[-1].rstrip(".")) if sentences else own)
        return cls(ids, words, answers, np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64))

    def passages(self) -> list[tuple[int, np.ndarray]]:
        """(item number, word hashes): whole items up to WINDOW words, else windows of them; short items have none."""
        out = []
        for i, w in enumerate(self.words):
            if len(w) < SHORT:
                continue
            starts = range(0, max(len(w) - WINDOW, 0) + HALF, HALF) if len(w) > WINDOW else [0]
            out += [(i, w[s : s + WINDOW]) for s in starts if len(w[s : s + WINDOW]) > HALF or s == 0]
        return out


_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]"]] = True


def _word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Row and hash of every word, lower-cased and without punctuation at its end."""
    starts, stops, row = shared.spans(data, offsets)
    for _ in range(2):
        stops = stops - (_EDGE[data[stops - 1]] & (stops - starts > 1))
    sums = shared._WORDS.prefix(shared._LOWER[data])
    return row, mix64(shared._WORDS.of(sums, starts, stops))


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _word_hashes(raw, np.array([0, len(raw)]))[1] if len(raw) else np.zeros(0, np.uint64)


def _terms(h: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Number of each word's term; a word that the benchmark lacks has the number after the last."""
    if not len(terms):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, len(terms))


class Numbers:
    """Number of each word hash in a sorted list of them; a hash that it lacks has the number after the last. Hashes are uniform, so
    that their leading bits lead to the few places where one can stand."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        bits = min(len(terms).bit_length() + 2, 24)
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.start = np.append(np.searchsorted(terms, edges), len(terms)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.terms), np.int64)
        bucket = (h >> self.shift).astype(np.int64)
        at, stop = self.start[bucket], self.start[bucket + 1]
        left = np.flatnonzero(at < stop)
        at, stop, own = at[left], stop[left], h[left]
        while len(left):
            hit = self.terms[at] == own
            out[left[hit]] = at[hit]
            more = ~hit & (at + 1 < stop)
            left, at, stop, own = left[more], at[more] + 1, stop[more], own[more]
        return out


def _lines(row: np.ndarray, rows: int, width: int):
    """Lay the words of each row out in lines of ``width``: place of each word, row of each line, first word and first line of each row."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    position = np.arange(len(row)) - first[row]
    lines = -(-count // width)
    line_first = np.concatenate([[0], np.cumsum(lines)])
    return (line_first[row] + position // width) * width + position % width, np.repeat(np.arange(rows), lines), first, line_first


def _take(table: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row of ``at``, the sum of those rows of ``table``, weighted; a few at a time, so that they stay in the cache."""
    out = np.empty((len(at), 1, table.shape[1]), np.float32)
    few = max(1, 2_048 // at.shape[1])
    buffer = np.empty((few, at.shape[1], table.shape[1]), np.float32)
    for a in range(0, len(at), few):
        own = buffer[: len(at[a : a + few])]
        np.take(table, at[a : a + few], axis=0, out=own, mode="clip")
        np.matmul(weight[a : a + few, None], own, out=out[a : a + few])
    return out[:, 0]


def _add_rows(key: np.ndarray, weight: np.ndarray, source: np.ndarray, z: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``keys`` numbers, the sum of ``weight * z[source]``, and how many sources it has: sorted, then added in groups."""
    order = np.argsort(key.astype(np.uint16) if keys <= 1 << 16 else key, kind="stable")
    key, weight, source = key[order], weight[order], source[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (source[1:] != source[:-1])
    distinct = np.bincount(key[new], minlength=keys)
    sums = np.zeros((keys, z.shape[1]), np.float32)
    while len(key):
        size = np.bincount(key, minlength=keys)
        width = 16 if len(key) > 8 * np.count_nonzero(size) else 4
        groups = -(-size // width)
        place = ((np.cumsum(groups) - groups) * width - (np.cumsum(size) - size))[key] + np.arange(len(key))
        n = int(groups.sum())
        weights, sources = np.zeros(n * width, np.float32), np.zeros(n * width, np.int64)
        weights[place], sources[place] = weight, source
        z = _take(z, sources.reshape(n, width), weights.reshape(n, width))
        key = np.repeat(np.arange(keys), groups)
        alone = groups[key] == 1
        sums[key[alone]] = z[alone]
        source = np.flatnonzero(~alone)
        key, weight = key[source], np.ones(len(source), np.float32)
    return sums, distinct


def _passages(row: np.ndarray, rows: int, column: np.ndarray, idf: np.ndarray, basis: np.ndarray):
    """Every passage of WINDOW words one after the other, the last of a row shorter: weight and passage of each word, and the passages in
    ``basis``. The last row of it, of words without a column, is zero, but they count in the length of a passage."""
    place, lines, *_ = _lines(row, rows, WINDOW)
    line = place // WINDOW
    weight = idf[column]
    weight = (weight / np.sqrt(np.bincount(line, weights=weight**2))[line]).astype(np.float32)
    columns, weights = np.full(len(lines) * WINDOW, len(basis) - 1), np.zeros(len(lines) * WINDOW, np.float32)
    columns[place], weights[place] = column, weight
    return weight, line, _take(basis, columns.reshape(-1, WINDOW), weights.reshape(-1, WINDOW))


def _chunks(batches):
    """Rows, words and number of rows of each chunk of texts that has words."""
    for batch in batches:
        data, offsets = shared.utf8(batch.column(0))
        for a, b in shared.row_chunks(offsets, CHUNK):
            if offsets[b] > offsets[a]:
                row, h = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield row, h, b - a, int((np.diff(offsets[a : b + 1]) > 0).sum())


TERM, TOTAL, WORD = range(3)


def _count_batches(number):
    """Documents with each term; documents with text, and passages; and words with their counts, of GROUP words at a time those that have at least
    a quarter of SHARE in it, so that what is left out of a word's sum is less than that quarter of all passages."""

    def run(batches):
        find = Numbers(number.value)
        terms = len(find.terms)
        df, totals = np.zeros(terms, np.int64), np.zeros(2, np.int64)
        group: list[np.ndarray] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        passages = 0

        def rows(kind, number, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind), pa.int32()), pa.array(number, pa.int64()), pa.array(n, pa.int64())], ["kind", "number", "n"])

        def summed():
            words, back = np.unique(np.concatenate([w for w, _ in counted]), return_inverse=True)
            return words, np.bincount(back, weights=np.concatenate([n for _, n in counted]), minlength=len(words)).astype(np.int64)

        def count():
            words, n = np.unique(np.concatenate(group), return_counts=True)
            often = n >= SHARE / 4 * passages
            counted.append((words[often], n[often]))

        for row, h, n_rows, texts in _chunks(batches):
            term = find(h)
            known = np.flatnonzero(term < terms)
            order = known[np.argsort(term[known].astype(np.uint16) if terms <= 1 << 16 else term[known], kind="stable")]
            key, of = term[order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            df += np.bincount(key[new], minlength=terms)
            n = int((-(-np.bincount(row, minlength=n_rows) // WINDOW)).sum())
            totals += (texts, n)
            group.append(h)
            passages += n
            if sum(map(len, group)) > GROUP:
                count()
                group, passages = [], 0
                if sum(len(w) for w, _ in counted) > GROUP:
                    words, n = summed()
                    counted = [(words, n)]
                    if len(words) > GROUP // 2:
                        yield rows(WORD, words.view(np.int64), n)
                        counted = []
        if group:
            count()
        if counted:
            words, n = summed()
            yield rows(WORD, words.view(np.int64), n)
        some = np.flatnonzero(df)
        yield rows(TERM, some, df[some])
        yield rows(TOTAL, np.arange(2), totals)

    return run


def _counts(texts: DataFrame, terms) -> tuple[np.ndarray, int, int, np.ndarray]:
    """Documents with each term, documents with text, passages; and all words that may be in SHARE of the passages, with others that are near it."""
    counts = cut(texts.mapInArrow(_count_batches(terms), "kind int, number long, n long").groupBy("kind", "number").agg(F.sum("n").alias("n")))
    df, totals = np.zeros(len(terms.value), np.int64), np.zeros(2, np.int64)
    for r in counts.where(F.col("kind") != WORD).collect():
        (df if r["kind"] == TERM else totals)[r["number"]] = r["n"]
    often = counts.where((F.col("kind") == WORD) & (F.col("n") >= 0.75 * SHARE * float(totals[1])) & (F.col("n") >= LEAST)).select("number")
    return df, int(totals[0]), int(totals[1]), np.array([r["number"] for r in often.collect()], np.int64).view(np.uint64)


PRODUCT, COUNTS = range(2)
_KINDS = ("f4", "i8")


def _product_batches(columns, idf, basis):
    """A'A times ``basis`` over all passages, and the passages that have each column."""

    def run(batches):
        find, q = Numbers(columns.value), basis.value
        n = len(find.terms)
        sums, passages = np.zeros((n, q.shape[1]), np.float32), np.zeros(n, np.int64)
        for row, h, rows, _ in _chunks(batches):
            column = find(h)
            weight, line, z = _passages(row, rows, column, idf.value, q)
            own = np.flatnonzero(column < n)
            added, distinct = _add_rows(column[own], weight[own], line[own], z, n)
            sums += added
            passages += distinct
        for kind, x in ((PRODUCT, sums.reshape(-1)), (COUNTS, passages)):
            starts = range(0, len(x), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(starts), pa.int32()), pa.array([s // BLOCK for s in starts], pa.int32()), pa.array([x[s : s + BLOCK].tobytes() for s in starts], pa.binary())], ["kind", "block", "sums"])

    return run


def _add_kinds(t: pa.Table) -> pa.Table:
    kind = _KINDS[t.column("kind")[0].as_py()]
    total = sum(np.frombuffer(b.as_buffer(), kind).astype("f8" if kind == "f4" else kind) for b in t.column("sums"))
    return pa.table([t.column("kind").slice(0, 1), t.column("block").slice(0, 1), pa.array([total.astype(kind).tobytes()], pa.binary())], schema=t.schema)


def _product(texts: DataFrame, columns, idf, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``_product_batches``. Texts are in a bounded number of tasks here, as each has sums of all columns."""
    sc = texts.sparkSession.sparkContext
    basis = np.concatenate([basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
    parts = texts.coalesce(max(ADDENDS, sc.defaultParallelism)).mapInArrow(_product_batches(columns, idf, sc.broadcast(basis)), "kind int, block int, sums binary")
    found: list[dict[int, np.ndarray]] = [{} for _ in _KINDS]
    for r in parts.groupBy("kind", "block").applyInArrow(_add_kinds, "kind int, block int, sums binary").toLocalIterator():
        found[r["kind"]][r["block"]] = np.frombuffer(r["sums"], _KINDS[r["kind"]])
    shapes = [(len(columns.value), basis.shape[1]), (len(columns.value),)]
    sums, passages = (np.concatenate([own[k] for k in sorted(own)]).reshape(shape) if own else np.zeros(shape) for own, shape in zip(found, shapes, strict=True))
    return sums.astype("f8"), passages


def _axes(sums: np.ndarray) -> np.ndarray:
    """Orthonormal axes of the columns of ``sums``, without weak ones."""
    if not sums.any():
        return sums[:, :0]
    q, s, _ = np.linalg.svd(sums, full_matrices=False)
    return q[:, s > s[0] * 1e-6]


def _corpus_axes(texts: DataFrame, terms, idf: np.ndarray, n_passages: int, often: np.ndarray):
    """Axes of frequent words; and the words that stand for terms (hashes, sorted), numbers of those terms and cosines.

    Subspace iteration over all passages. Both spaces take part in the same passes: axes of terms alone, and axes of all words that
    SHARE of the passages have (LEAST at least), which are at most WINDOW / SHARE.
    """
    sc, rng = texts.sparkSession.sparkContext, np.random.default_rng(5)
    columns = np.union1d(terms.value, often)
    number = _terms(columns, terms.value)
    benchmark = number < len(terms.value)
    shared_columns, weights = sc.broadcast(columns), sc.broadcast(idf[np.append(number, len(terms.value))])
    frequent = rng.standard_normal((len(columns), CORPUS_AXES)) * benchmark[:, None]
    meaning = rng.standard_normal((len(columns), MEANING))
    for _ in range(CORPUS_PRODUCTS):
        frequent, meaning = _axes(frequent), _axes(meaning)
        sums, passages = _product(texts, shared_columns, weights, np.concatenate([frequent, meaning], axis=1))
        seen = passages >= max(LEAST, SHARE * n_passages)
        at = frequent.shape[1]
        frequent, meaning = sums[:, :at] * benchmark[:, None], sums[:, at:] * seen[:, None]
    return _axes(frequent)[benchmark], *alike(columns[seen], _axes(meaning[seen]), terms.value)


def alike(vocabulary: np.ndarray, axes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of ``vocabulary`` outside ``terms`` whose row of ``axes`` is like a term's: hashes (sorted), numbers of those terms, cosines from ALIKE on."""
    rows = axes / np.maximum(np.linalg.norm(axes, axis=1, keepdims=True), 1e-12)
    number = _terms(vocabulary, terms)
    inside, outside = np.flatnonzero(number < len(terms)), np.flatnonzero(number == len(terms))
    words, near, cosines = [], [], []
    for part in np.array_split(outside, -(-len(outside) // COUNT_BLOCK)) if len(inside) and len(outside) else []:
        like = rows[part] @ rows[inside].T
        best = like.argmax(axis=1)
        top = like[np.arange(len(part)), best]
        words.append(vocabulary[part[top >= ALIKE]])
        near.append(number[inside[best[top >= ALIKE]]])
        cosines.append(np.minimum(top[top >= ALIKE], 1.0))
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(words), np.concatenate(near), np.concatenate(cosines)


def _add_blocks(kind: str):
    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, kind) for b in t.column("sums").to_pylist())
        return pa.table({"block": t.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())}, schema=t.schema)

    return add


def _collect_blocks(df: DataFrame, kind: str, places: list[int], size: int) -> np.ndarray:
    """Sum the arrays of at most ADDENDS tasks block by block; block k belongs at ``places[k]`` of an array of ``size``."""
    out = np.zeros(size, kind)
    for r in df.groupBy("block").applyInArrow(_add_blocks(kind), "block int, sums binary").collect():
        own = np.frombuffer(r["sums"], kind)
        out[places[r["block"]] : places[r["block"]] + len(own)] = own
    return out


def latent_spaces(passages: DataFrame, shapes: list[tuple[int, int]], rounds: int = POWER_ROUNDS, seed: int = 5, tasks: int = ADDENDS) -> list[np.ndarray]:
    """For each of ``shapes`` (terms, rank), the right singular vectors of the matrix whose rows are ``passages(space, terms, weights)`` of it.

    All spaces take part in the same jobs, in at most ``tasks``; a task holds the sums of one space at a time.
    """
    passages = passages.coalesce(tasks).sortWithinPartitions("space")
    sc = passages.sparkSession.sparkContext
    rng = np.random.default_rng(seed)
    bases = [rng.standard_normal(shape) for shape in shapes]
    steps = [max(1, COUNT_BLOCK // rank) for _, rank in shapes]
    first = np.concatenate([[0], np.cumsum([-(-n // step) for (n, _), step in zip(shapes, steps, strict=True)])]).tolist()
    ends = np.cumsum([n * rank for n, rank in shapes])
    places = [int(end - n * rank + s * rank) for end, (n, rank), step in zip(ends, shapes, steps, strict=True) for s in range(0, n, step)]

    def product(q):
        def blocks(k, y):
            starts = range(0, len(y), steps[k])
            return pa.RecordBatch.from_arrays([pa.array([first[k] + s // steps[k] for s in starts], pa.int32()), pa.array([y[s : s + steps[k]].tobytes() for s in starts], pa.binary())], ["block", "sums"])

        def run(batches):
            now, y = None, None
            for batch in batches:
                for k, t, w in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    if k != now:
                        if y is not None:
                            yield blocks(now, y)
                        now, y = k, np.zeros(shapes[k])
                    w = np.array(w)
                    np.add.at(y, t, w[:, None] * (w @ q.value[k][t])[None, :])
            if y is not None:
                yield blocks(now, y)

        return run

    for _ in range(rounds + 1):
        bases = [np.linalg.qr(basis)[0] for basis in bases]
        sums = _collect_blocks(passages.mapInArrow(product(sc.broadcast(bases)), "block int, sums binary"), "f8", places, int(ends[-1]))
        bases = [part.reshape(shape) for part, shape in zip(np.split(sums, ends[:-1]), shapes, strict=True)]
    out = []
    for basis in bases:
        # A'A restricted to the basis: its eigenvectors order the axes, weak ones go
        q, r = np.linalg.qr(basis)
        _, s, _ = np.linalg.svd(r)
        out.append(np.ascontiguousarray(q[:, : max(1, int((s > s[0] * 1e-12).sum()))]))
    return out


def latent_space(passages: DataFrame, n_terms: int, rank: int = RANK, rounds: int = POWER_ROUNDS, seed: int = 5) -> np.ndarray:
    """Right singular vectors (n_terms, rank) of the matrix whose rows are ``passages(terms, weights)``."""
    return latent_spaces(passages.select(F.lit(0).alias("space"), "terms", "weights"), [(n_terms, rank)], rounds, seed)[0]


def common_subsequence(a: list[int], b: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine step a word (Hyyro 2004)."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        if m := places.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _run(hits: list[int], n: int) -> int:
    """Length of the longest common subsequence from the places (of n, as bits) of each word that both have."""
    v = full = (1 << n) - 1
    for m in hits:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@dataclass
class Space:
    """Latent space of some passages: row of ``axes`` for each term (the last row is of all others, zero), axes times weights, and the passages in it.

    ``bound`` has, for each row and each of GROUPS of passages, the most that the word adds to the product with one of them.
    """

    local: np.ndarray
    axes: np.ndarray
    owner: np.ndarray
    latent: np.ndarray

    def __post_init__(self) -> None:
        score = np.maximum(self.axes @ self.latent.T, 0)
        self.bound = np.stack([score[:, g].max(axis=1) for g in np.array_split(np.arange(len(self.latent)), min(GROUPS, len(self.latent)))], axis=1)


@dataclass
class Index:
    items: Items
    idf: np.ndarray  # of terms, and of a word that the benchmark lacks
    spaces: list[Space]
    other: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # words that stand for terms, sorted
    near: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # those terms
    like: np.ndarray = field(default_factory=lambda: np.zeros(0))  # and by how much

    def __post_init__(self) -> None:
        """Short items by their rarest word: its term, sorted, the item and the word's place in it; places of each item's words."""
        short = []
        self.find, self.find_other = Numbers(self.items.terms), Numbers(self.other)
        self.places: list[dict[int, int]] = []
        for i, w in enumerate(self.items.words):
            t = _terms(w, self.items.terms)
            if len(w) < SHORT:
                k = int(self.idf[t].argmax())
                short.append((int(t[k]), i, k))
            places: dict[int, int] = {}
            for k, word in enumerate(t.tolist()):
                places[word] = places.get(word, 0) | (1 << k)
            self.places.append(places)
        self.short = sorted(short)

    def _short(self, term: np.ndarray, h: np.ndarray, row: np.ndarray):
        """(row, item number, cosine, shares) of the short items whose words stand in a row."""
        anchors = np.array([t for t, _, _ in self.short])
        anchor = np.zeros(len(self.items.terms) + 1, bool)
        anchor[anchors] = True
        some = np.flatnonzero(anchor[term])
        order = some[np.argsort(term[some], kind="stable")]
        low, high = (np.searchsorted(term[order], anchors, side) for side in ("left", "right"))
        found = {}
        for k in np.flatnonzero(high > low).tolist():
            _, item, place = self.short[k]
            words = self.items.words[item]
            at = order[low[k] : high[k]] - place
            at = at[(at >= 0) & (at + len(words) <= len(h))]
            for j, w in enumerate(words):
                at = at[h[at + j] == w]
            at = at[row[at] == row[at + len(words) - 1]]
            found.update({(r, item): (r, item, 1.0, 1.0, 1.0) for r in row[at].tolist()})
        return list(found.values())

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item number, cosine, share of the item's words, share of the answer's words) of every leak."""
        items = self.items
        row, h = _word_hashes(data, offsets)
        if not len(h):
            return []
        n = len(items.terms)
        term = self.find(h)
        stands, scale = term, np.ones(len(h), np.float32)
        if len(self.other):
            lacks = np.flatnonzero(term == n)
            place = self.find_other(h[lacks])
            lacks, place = lacks[place < len(self.other)], place[place < len(self.other)]
            stands = term.copy()
            stands[lacks], scale[lacks] = self.near[place], self.like[place]
        # halves of a window: HALF words of one row each
        place, half_row, first, half_first = _lines(row, len(offsets) - 1, HALF)
        # a word's weight counts its repeats in a half once each; close enough to the window's own
        norm = np.bincount(place // HALF, weights=self.idf[term] ** 2, minlength=len(half_row))
        follows = np.zeros(len(norm), bool)
        follows[:-1] = half_row[1:] == half_row[:-1]
        wide = np.sqrt(norm + np.where(follows, np.roll(norm, -1), 0)).astype(np.float32)
        laid, scales = np.full(len(norm) * HALF, n), np.zeros(len(norm) * HALF, np.float32)
        laid[place], scales[place] = stands, scale
        laid, scales = laid.reshape(-1, HALF), scales.reshape(-1, HALF)
        out = []
        for space in self.spaces:
            out += self._candidates(space, space.local[laid], scales, wide, follows)
        best: dict[tuple[int, int], tuple] = {}
        number = -1
        for w, item, cosine in sorted(out, key=lambda c: (c[1], -c[2])):
            r = int(half_row[w])
            if (r, item) in best:
                continue
            if item != number:
                number, words, places = item, items.words[item], self.places[item]
                own = np.full(n + 1, len(places))
                own[list(places)] = np.arange(len(places))
                times = np.array([m.bit_count() for m in places.values()])
            a = first[r] + (w - half_first[r]) * HALF
            around = term[max(first[r], a - len(words)) : min(first[r + 1], a + WINDOW + len(words))]
            # no subsequence is longer than the words that both have
            if np.minimum(np.bincount(own[around], minlength=len(places) + 1)[:-1], times).sum() < PARAPHRASE * len(words):
                continue
            share = _run([m for t in around.tolist() if (m := places.get(t))], len(words)) / len(words)
            if share < PARAPHRASE:
                continue
            around = h[max(first[r], a - len(words)) : min(first[r + 1], a + WINDOW + len(words))]
            answer = common_subsequence(items.answers[item].tolist(), around) / len(items.answers[item])
            if share >= SURE or answer >= ANSWER:
                best[r, item] = (r, item, cosine, share, answer)
        return [*best.values(), *(self._short(term, h, row) if self.short else [])]

    def _candidates(self, space: Space, own: np.ndarray, scales: np.ndarray, wide: np.ndarray, follows: np.ndarray):
        """(window, item number, cosine) from COSINE on; ``own`` has the row of ``space`` of each word of each half."""
        after = np.minimum(np.arange(len(wide)) + 1, len(wide) - 1)

        most = _take(space.bound, own, scales)
        most = (most + np.where(follows[:, None], most[after], 0)).max(axis=1)
        window = np.flatnonzero((most >= COSINE * (1 - 1e-4) * wide) & (most > 0))
        if not len(window):
            return []
        need = np.zeros(len(wide), bool)
        need[window] = True
        need[1:] |= need[:-1] & follows[:-1]
        kept = np.flatnonzero(need)
        place = np.zeros(len(wide), np.int64)
        place[kept] = np.arange(len(kept))
        vectors = _take(space.axes, own[kept], scales[kept])
        out = []
        for a in range(0, len(window), 4096):
            w = window[a : a + 4096]
            x = vectors[place[w]] + np.where(follows[w, None], vectors[place[after[w]]], 0)
            cosine = (x @ space.latent.T) / wide[w, None]
            i, j = np.nonzero(cosine >= COSINE)
            out += zip(w[i].tolist(), space.owner[j].tolist(), cosine[i, j].tolist(), strict=True)
        return out


def _search_batches(index):
    def run(batches):
        ix = index.value
        for batch in batches:
            data, offsets = shared.utf8(batch.column(1))
            rows = []
            for a, b in shared.row_chunks(offsets):
                rows += [(a + r, ix.items.ids[i], c, s, x) for r, i, c, s, x in ix.search(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])],
                ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
            )

    return run


def build_index(docs: DataFrame, items: Items) -> Index:
    spark = docs.sparkSession
    texts, terms = docs.select("text"), spark.sparkContext.broadcast(items.terms)
    n_terms = len(items.terms)
    df, n, n_passages, often = _counts(texts, terms)
    idf = np.log((n + 1) / (np.minimum(df, n) + 1)) + 0.05
    idf = np.append(idf, np.median(idf))
    rows = []
    for i, w in items.passages():
        t = _terms(w, items.terms)
        v = idf[t] / math.sqrt(float((idf[t] ** 2).sum()))
        term, back = np.unique(t, return_inverse=True)
        rows.append((i, term, np.bincount(back, weights=v)))
    if not rows:
        return Index(items, idf, [])
    corpus, other, near, cosines = _corpus_axes(texts, terms, idf, n_passages, often)
    rows = [(i, t, v - (1 - DAMP) * corpus[t] @ (corpus[t].T @ v)) for i, t, v in rows]
    parts = np.array_split(np.arange(len(rows)), -(-len(rows) // RANK))
    own = [np.unique(np.concatenate([rows[r][1] for r in part])) for part in parts]
    local = [[(np.searchsorted(terms, rows[r][1]), rows[r][2]) for r in part] for part, terms in zip(parts, own, strict=True)]
    passages = spark.createDataFrame([(k, t.tolist(), v.tolist()) for k, part in enumerate(local) for t, v in part], "space int, terms array<int>, weights array<double>")
    axes = latent_spaces(passages, [(len(terms), min(len(part), len(terms))) for part, terms in zip(parts, own, strict=True)])
    spaces = []
    for part, terms, inside, q in zip(parts, own, local, axes, strict=True):
        latent = np.stack([(q[t] * v[:, None]).sum(axis=0) / math.sqrt(float((v * v).sum())) for t, v in inside])
        # divided by what the space keeps of a passage, so that a whole copy has cosine 1
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        places = np.full(n_terms + 1, len(terms), np.int32)
        places[terms] = np.arange(len(terms))
        weighed = np.concatenate([q * idf[terms, None], np.zeros((1, q.shape[1]))])
        spaces.append(Space(places, weighed.astype(np.float32), np.array([rows[r][0] for r in part]), latent.astype(np.float32)))
    return Index(items, idf, spaces, other, near, cosines.astype(np.float32))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` and ``benchmark(item_id, text)`` to ``(doc_id, item_id, cosine, lcs_share, answer_share)``.

    One row for each document (row of ``docs``) and benchmark item found in it. Null, empty and white
    texts on either side match nothing; equal items are all reported, and so are ties. Documents of any length are
    searched whole, in windows of 48 words that overlap by half. An item of fewer than 12 words counts where its words stand
    in a row (lower-cased, without punctuation at their ends); its cosine and shares are 1. Extra columns are ignored; an empty table on either side gives an
    empty result.
    """
    docs = shared.only(docs, "doc_id", "text")
    rows = shared.only(benchmark, "item_id", "text").where("length(text) > 0").orderBy("item_id").toLocalIterator()
    found, part, size = [], [], 0
    for row in chain(rows, [None]):
        if row is None or size > MOST_WORDS:
            items = Items.read(part)
            if items.ids:
                index = docs.sparkSession.sparkContext.broadcast(build_index(docs, items))
                found.append(docs.mapInArrow(_search_batches(index), _RESULT))
            part, size = [], 0
        if row is not None:
            part.append((row["item_id"], row["text"]))
            size += len(row["text"].split())
    out = found[0] if found else docs.sparkSession.createDataFrame([], _RESULT)
    for more in found[1:]:
        out = out.union(more)
    return out


_RESULT = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
