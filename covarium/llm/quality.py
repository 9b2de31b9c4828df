"""Quality classification by hierarchical empirical Bayes.

Evidence of a document is a log-odds from a logistic model of text features (quality) and from a
lexicon of words (toxicity), both learned from all labelled rows by sums over their partitions. Both go through the same hierarchy: hosts and the
paths below them have Beta posteriors of their good and of their toxic share. A path's share is shrunk towards its host's, a
host's towards the global one, with strengths found by moments from the grouped sums. A document's
posterior odds are its own odds times the odds of its path (without the document itself) relative to the global odds.
Sites with few documents thus stay at the global prior, and where sites do not differ, so do all.

The text is read three times: of labelled rows by the fit, of all rows by the grouped sums and by the final scores. Beyond sums, the fit
shuffles words of toxic rows and numbers of those words that may be in the lexicon; and the labelled
texts, with few others: bitmaps of the hashes of labelled ids go to all tasks first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covarium.llm import shared
from covarium.llm.shared import cut

#: A toxic word needs so many toxic witnesses, such a share of them, and such log-odds. The lexicon holds all words that have these, at most
#: the mean number of words of a toxic witness divided by LEXICON_SHARE.
LEXICON_LEAST, LEXICON_SHARE, LEXICON_ODDS = 3, 0.008, 3.9
BROADCAST_PATHS = 200_000
#: Bits of the bitmaps for each label: one text in so many without a label is shuffled as well.
MARKS = 16
KEEP_QUALITY, KEEP_TOXIC = 0.5, 0.98

_CLASS = np.zeros((256, 5), np.int64)  # upper case, digit, symbol, letter, bar
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'\"-:;()"], 2] = 1
_CLASS[65:91, 3] = _CLASS[97:123, 3] = _CLASS[128:, 3] = 1
_CLASS[124, 4] = 1
N_FEATURES = 13


def features(data: np.ndarray, offsets: np.ndarray):
    """Feature matrix (rows, N_FEATURES), word counts, and (row, hash) of the words stripped of nothing."""
    rows = len(offsets) - 1
    starts, stops, row, h = shared.words(data, offsets)
    n = np.bincount(row, minlength=rows)
    size = np.maximum(np.diff(offsets), 1)
    sums = np.zeros((rows, 5))
    for k in range(5):
        run = np.concatenate([[0], np.cumsum(_CLASS[data, k])])
        sums[:, k] = run[offsets[1:]] - run[offsets[:-1]]
    words = np.maximum(n, 1)
    ends = np.bincount(row, weights=_CLASS[data[stops - 1], 2], minlength=rows) if len(row) else np.zeros(rows)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again = np.bincount(row, weights=same, minlength=rows)
    key = (row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    key.sort()
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[first] >> np.uint64(48)).astype(np.int64), minlength=rows)
    shout = np.zeros(len(h))
    if len(h):
        run = np.concatenate([[0], np.cumsum(_CLASS[data, 0])])
        shout = ((run[stops] - run[starts]) * 2 > stops - starts) & (stops - starts > 2)
    shouted = np.bincount(row, weights=shout, minlength=rows)
    letters = np.maximum(sums[:, 3], 1)
    x = np.stack(
        [
            np.log1p(n),
            size / words,
            sums[:, 0] / letters,
            np.log1p(sums[:, 2]),
            sums[:, 2] / size,
            sums[:, 1] / size,
            ends / words,
            np.log1p(ends),
            again / words,
            np.log1p(again),
            distinct / words,
            np.log1p(shouted),
            np.log1p(sums[:, 4]),
        ],
        axis=1,
    )
    return x, n, key[first]


@dataclass
class Model:
    """Standardisation and weights of the logistic model, the toxic lexicon (48-bit hashes, log-odds) and its prior."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    lexicon: np.ndarray
    odds: np.ndarray
    toxic_prior: float

    def score(self, data: np.ndarray, offsets: np.ndarray):
        """Log-odds of good quality and of toxicity for each row, and its word count."""
        x, n, key = features(data, offsets)
        rows = len(n)
        good = np.full(rows, 4.0)
        if self.weights is not None:
            z = (x - self.mean) / self.scale
            good = np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)
        toxic = np.full(rows, self.toxic_prior)
        if len(self.lexicon) and len(key):
            h = key & np.uint64((1 << 48) - 1)
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            hit = self.lexicon[at] == h
            toxic = toxic + np.bincount((key[hit] >> np.uint64(48)).astype(np.int64), weights=self.odds[at[hit]], minlength=rows)
        return good, np.clip(toxic, -30, 30), n


def logistic(sums, size: int, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) by Newton's method with a small ridge; ``sums(w)`` is the slope and the bend of all rows at ``w``."""
    w = np.zeros(size)
    for _ in range(40):
        slope, bend = sums(w)
        step = np.linalg.solve(bend + ridge * np.eye(size), slope + ridge * np.concatenate([[0], w[1:]]))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def witnesses(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each row that near-copies of a text mostly share and other texts don't: two minima over its 5-word shingles."""
    rows = len(offsets) - 1
    _, _, row, h = shared.words(data, offsets)
    row, h = shared.shingles(h, row, rows)
    out = np.zeros(rows, np.uint64)
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        least = np.full(rows, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, row, shared.mix64(h + np.uint64(salt)))
        out = shared.mix64(out * np.uint64(0x9E3779B97F4A7C15) + least)
    return out


def _labelled_batches(batches):
    for batch in batches:
        data, offsets = shared.utf8(batch.column(1))
        for a, b in shared.row_chunks(offsets):
            x, n, key = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            witness = witnesses(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            counts = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=b - a)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2).slice(a, b - a),
                    batch.column(3).slice(a, b - a),
                    shared.list_array(x.ravel(), np.full(b - a, N_FEATURES), pa.float64()),
                    shared.list_array((key & np.uint64((1 << 48) - 1)).view(np.int64), counts, pa.int64()),
                    pa.array(witness.view(np.int64)),
                ],
                ["quality", "toxic", "x", "words", "witness"],
            )


def _summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum of ``of(x, quality)``, ``size`` numbers, over all rows; one such row leaves a task."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += of(batch.column(0).flatten().to_numpy().reshape(-1, N_FEATURES), batch.column(1).to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([shared.list_array(total, np.array([size]), pa.float64())], ["sums"])

    return np.sum([r["sums"] for r in rows.select("x", "quality").mapInArrow(run, "sums array<double>").collect()] or [np.zeros(size)], axis=0)


def _quality(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features, and weights of the logistic model, over all rows: a pass for each of the first two and for each step."""
    n, *total = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0)]), 1 + N_FEATURES)
    mean = np.array(total) / n
    scale = np.maximum(np.sqrt(_summed(rows, lambda x, y: ((x - mean) ** 2).sum(axis=0), N_FEATURES) / n), 1e-9)
    size = 1 + N_FEATURES

    def sums(w):
        def of(x, y):
            x = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.concatenate([x.T @ (p - y), ((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x).ravel()])

        both = _summed(rows, of, size + size * size)
        return both[:size], both[size:].reshape(size, size)

    return mean, scale, logistic(sums, size)


def _known_batches(words):
    """For each witness of a batch, the numbers of those of ``words`` that its rows have."""

    def run(batches):
        known = words.value
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            h = lists.flatten().to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            witness, back = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            key = np.unique(back[row[hit]] * len(known) + at[hit])
            counts = np.bincount(key // len(known), minlength=len(witness))
            yield pa.RecordBatch.from_arrays([pa.array(witness), shared.list_array((key % len(known)).astype(np.int32), counts, pa.int32())], ["witness", "known"])

    return run


def _witness_counts(size: int):
    """Witnesses that have each number, from rows sorted by witness; of one that batches share, ``had`` are the numbers so far."""

    def run(batches):
        n, had, last = np.zeros(size, np.int64), np.zeros(size, bool), None
        for batch in batches:
            if not batch.num_rows:
                continue
            witness, lists = batch.column(0).to_numpy(), batch.column(1)
            group = np.concatenate([[0], np.cumsum(witness[1:] != witness[:-1])])
            key = np.unique(np.repeat(group, lists.value_lengths().to_numpy()) * size + lists.flatten().to_numpy())
            group_of, number = key // size, key % size
            if witness[0] != last:
                had[:] = False
            n += np.bincount(number[(group_of > 0) | ~had[number]], minlength=size)
            if group[-1] > 0:
                had[:] = False
            had[number[group_of == group[-1]]] = True
            last = witness[-1]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["number", "n"])

    return run


def _lexicon(marked: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Toxic words, their log-odds, and the prior, from all of ``marked(toxic, witness, words)``. Near-copies of one text are one witness.

    Words of enough toxic witnesses are found first, so that only these are counted among the others.
    """
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.countDistinct("witness").alias("n")).collect()}
    bad, fine = totals.get(1, 0), totals.get(0, 0)
    if not bad or not fine:
        return np.zeros(0, np.uint64), np.zeros(0), -4.0
    prior = float(np.log(bad / fine))
    seen = marked.where("toxic = 1").select("witness", F.explode("words").alias("w")).distinct()
    often = seen.groupBy("w").agg(F.count("*").alias("b")).where(F.col("b") >= max(LEXICON_LEAST, LEXICON_SHARE * bad)).collect()
    words, b = np.array([r["w"] for r in often], np.int64).view(np.uint64), np.array([r["b"] for r in often], np.int64)
    if not len(words):
        return words, np.zeros(0), prior
    order = np.argsort(words)
    words, b, f = words[order], b[order], np.zeros(len(words), np.int64)
    known = marked.where("toxic = 0").select("witness", "words").mapInArrow(_known_batches(marked.sparkSession.sparkContext.broadcast(words)), "witness long, known array<int>")
    counts = known.repartition("witness").sortWithinPartitions("witness").mapInArrow(_witness_counts(len(words)), "number int, n long")
    for r in counts.groupBy("number").agg(F.sum("n").alias("n")).collect():
        f[r["number"]] = r["n"]
    odds = np.log((b + 0.5) / (bad + 1.0)) - np.log((f + 0.5) / (fine + 1.0))
    return words[odds >= LEXICON_ODDS], odds[odds >= LEXICON_ODDS], prior


def _marked(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """All of ``texts`` whose doc_id is in ``labels``, and about one in MARKS others, without a shuffle of texts."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS * max(labels.count(), 1))) + 1
    marks = labels.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_marks"))
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("_marks", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2) == 1
    return texts.join(F.broadcast(marks), (F.bitmap_bucket_number(place) == F.col("_bucket")) & hit, "left_semi")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents.

    Rows of ``labels(doc_id, quality, toxic)`` without a label or a document are left out. Without
    labels of both kinds the evidence is neutral.
    """
    labels = labels.select("doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    texts = shared.only(docs, "doc_id", "text").where("length(text) > 0")
    labelled = cut(_marked(texts, labels.select("doc_id")).join(labels.hint("merge"), "doc_id").select("doc_id", "text", "quality", "toxic").mapInArrow(_labelled_batches, "quality int, toxic int, x array<double>, words array<long>, witness long"))
    rows = labelled.where("quality is not null")
    weights, mean, scale = None, np.zeros(N_FEATURES), np.ones(N_FEATURES)
    if rows.select("quality").distinct().count() == 2:
        mean, scale, weights = _quality(rows)
    return Model(mean, scale, weights, *_lexicon(labelled.where("toxic is not null and size(words) > 0").select("toxic", "witness", "words")))


def _scores(model, text: int | None = None):
    """The columns but the last, and the evidence of the text: the last column, or that field of the first."""

    def run(batches):
        for batch in batches:
            first = batch.num_columns - (text is None)
            data, offsets = shared.utf8(batch.column(first) if text is None else batch.column(0).field(text))
            parts = [model.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in shared.row_chunks(offsets)]
            good, toxic, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
            names = [*batch.schema.names[:first], "good", "toxic", "n"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], pa.array(good), pa.array(toxic), pa.array(n.astype(np.int64))], names)

    return run


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


KINDS = ("good", "toxic")


def _strengths(groups: DataFrame, parent_mean: dict[str, Column]) -> dict[str, float]:
    """Moment estimates of each kind's Beta prior strength: m (1 - m) / variance between the groups, less 1."""
    sums = [F.sum("n").alias("n"), F.count("*").alias("k")]
    for kind in KINDS:
        m = F.least(F.greatest(parent_mean[kind], F.lit(1e-4)), F.lit(1 - 1e-4))
        s, seen = F.col(f"s_{kind}"), F.col(f"s_{kind}") / F.col("n")
        # the spread of means beyond what sampling explains, weighted by size
        sums += [F.sum(F.col("n") * (seen - m) * (seen - m)).alias(f"between_{kind}"), F.sum(F.col(f"q_{kind}") - s * s / F.col("n")).alias(f"within_{kind}"), F.avg(m * (1 - m)).alias(f"full_{kind}")]
    r = groups.agg(*sums).first()
    out = {}
    for kind in KINDS:
        if not r["n"] or r["k"] < 2:
            out[kind] = 1e6
            continue
        noise = r[f"within_{kind}"] / max(r["n"] - r["k"], 1) * r["k"]
        variance = max((r[f"between_{kind}"] - noise) / r["n"], 1e-9)
        out[kind] = float(min(max(r[f"full_{kind}"] / variance - 1, 1.0), 1e6))
    return out


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """All columns of ``docs(doc_id, text, source, lang, ...)`` with ``p_quality``, ``p_toxic`` and ``kept``.

    ``host`` and ``path`` are string expressions of ``docs`` (by default source, and lang below it);
    nulls form a site of their own. Documents without words (null, empty or white texts) have p_quality 0, and are not kept
    nor counted for their site. Repeated rows are scored alike. Other columns of ``docs`` may have any names; those named as
    columns of the result are replaced; an empty table gives an empty one. Very long texts are read whole. Without usable labels
    every document with words is kept. Of repeated labels the lowest quality and the highest toxicity count.
    """
    host = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit(""))
    path = F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit(""))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    slim = docs.select(host.alias("_host"), path.alias("_path"), "text").mapInArrow(_scores(model), "_host string, _path string, good double, toxic double, n long")
    chance = {kind: _chance(F.col(kind)) for kind in KINDS}
    sums = [f(c).alias(f"{name}_{kind}") for kind, p in chance.items() for name, f, c in (("s", F.sum, p), ("q", F.sum, p * p))]
    paths = cut(slim.where("n > 0").groupBy("_host", "_path").agg(F.count("*").alias("n"), *sums))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), *[F.sum(f"{x}_{kind}").alias(f"{x}_{kind}") for kind in KINDS for x in "sq"])
    whole = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"s_{kind}").alias(kind) for kind in KINDS]).first()
    overall = {kind: float(whole[kind] / whole["n"]) if whole["n"] else 0.5 for kind in KINDS}
    strong = _strengths(hosts, {kind: F.lit(overall[kind]) for kind in KINDS})
    hosts = hosts.select("_host", *[((F.col(f"s_{kind}") + strong[kind] * overall[kind]) / (F.col("n") + strong[kind])).alias(f"_host_{kind}") for kind in KINDS])
    paths = paths.join(hosts, "_host")
    strong = _strengths(paths, {kind: F.col(f"_host_{kind}") for kind in KINDS})
    prior = cut(paths.select("_host", "_path", F.col("n").alias("_n"), *[c for kind in KINDS for c in (F.col(f"s_{kind}").alias(f"_s_{kind}"), f"_host_{kind}")]))
    if prior.count() <= BROADCAST_PATHS:
        prior = F.broadcast(prior)

    docs = docs.drop("p_quality", "p_toxic", "kept")
    whole_row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), host.alias("_host"), path.alias("_path"))
    schema = T.StructType([*whole_row.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("good", "toxic")), T.StructField("n", T.LongType())])
    scored = whole_row.mapInArrow(_scores(model, docs.columns.index("text")), schema)
    out = scored.join(prior, ["_host", "_path"], "left")
    for kind, name in zip(KINDS, ("p_quality", "p_toxic"), strict=True):
        mean = (F.col(f"_s_{kind}") - chance[kind] + strong[kind] * F.col(f"_host_{kind}")) / (F.col("_n") - 1 + strong[kind])
        p = min(max(overall[kind], 1e-6), 1 - 1e-6)
        base = float(np.log(p / (1 - p)))
        out = out.withColumn(name, F.when(F.col("n") > 0, _chance(F.col(kind) + _odds(mean) - base)).otherwise(0.0))
    kept = (F.col("p_quality") >= KEEP_QUALITY) & (F.col("p_toxic") < KEEP_TOXIC)
    return out.select("_doc.*", "p_quality", "p_toxic", kept.alias("kept"))
