"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary matches of a segment; dynamic programming keeps,
for each end, only the best score and the piece count (no back-pointers, no pieces). Tie rules are
those of the ``tokenizers`` library's Unigram model: a later candidate replaces an earlier one only
if its score is strictly higher, and candidates for one end come by start, longest piece first; a
character without a piece of its own may be unknown, at the least score less 10.

The default vocabulary is a BPE file, the only one of pieces with scores at hand: its scores are merge ranks, not
log-probabilities. The counts are those of the unigram model that these pieces and scores make, not those of the file's own
(BPE) tokenizer, of which they are about 1.15 times as many.

No piece of the vocabulary has a space after another character, so that a best segmentation of a
text is one of each of its segments (spaces, then other characters). Segments repeat: each distinct
one of a chunk is segmented once, and a bounded table remembers counts within a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm import shared
from covarium.llm.shared import Rolling, mix64

#: The space mark of the vocabulary, and the penalty of an unknown character.
MARK = "▁"
PENALTY = 10.0
TABLE_LIMIT = 300_000

_SEGMENTS = Rolling(31)


@dataclass
class Unigram:
    """Normal pieces with their scores, and whether unknown characters fall back to one piece a byte."""

    pieces: list[tuple[str, float]]
    bytes_as_pieces: bool

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        normal = [(sp.id_to_piece(i), float(sp.get_score(i))) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls(normal, sum(map(sp.is_byte, ids)) == 256)

    def counter(self) -> Counter:
        return Counter(self)


class Counter:
    """Counts pieces of segments; built once for each Python worker."""

    def __init__(self, model: Unigram) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in model.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if model.pieces:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in model.pieces), default=0.0) - PENALTY
        self.bytes_as_pieces = model.bytes_as_pieces
        self.splits = not any(MARK in p.lstrip(MARK) for p, _ in model.pieces)
        self.table: dict[bytes, tuple[int, float]] = {}

    def count(self, segment: str) -> tuple[int, float]:
        """Piece count and score of the best segmentation."""
        n = len(segment)
        score, count, was_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        unknown, as_bytes = self.unknown, self.bytes_as_pieces
        matches = self.automaton.iter(segment) if len(self.automaton) else iter(())
        ahead = next(matches, None)
        for end in range(n):
            best, pieces, lone = None, 0, False
            while ahead is not None and ahead[0] == end:
                length, s = ahead[1]
                start = end + 1 - length
                lone = lone or length == 1
                if best is None or score[start] + s > best:
                    best, pieces = score[start] + s, count[start] + 1
                ahead = next(matches, None)
            if not lone and (best is None or score[end] + unknown > best):
                best = score[end] + unknown
                pieces = count[end] + (len(segment[end].encode()) if as_bytes else 0 if was_unknown[end] else 1)
                was_unknown[end + 1] = True
            score[end + 1], count[end + 1] = best, pieces
        return count[n], score[n]


def _counts(model):
    def run(batches):
        counter = model.value.counter()
        for batch in batches:
            data, offsets = shared.utf8(batch.column(1))
            for a, b in shared.row_chunks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                tokens, score = _chunk(counter, part, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tokens), pa.array(score)], ["doc_id", "n_tokens", "score"])

    return run


def _chunk(counter: Counter, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    tokens, score = np.zeros(rows, np.int64), np.zeros(rows)
    if not len(data):
        return tokens, score
    new = np.zeros(len(data), bool)
    if counter.splits:
        space = data == 32
        new[1:] = space[1:] & ~space[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(new)
    stop = np.concatenate([start[1:], [len(data)]])
    row = np.searchsorted(offsets, start, side="right") - 1
    key = mix64(_SEGMENTS.of(_SEGMENTS.prefix(data), start, stop) + (stop - start).astype(np.uint64))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    size = stop - start
    other = np.repeat(start[first][inverse] - start, size) + np.arange(len(data))  # the byte of the first segment with the same hash
    if (size != size[first][inverse]).any() or (data[other] != data).any():  # hashes that meet: every segment by itself
        first = inverse = np.arange(len(start))
    raw, table = data.tobytes(), counter.table
    if len(table) > TABLE_LIMIT:
        table.clear()
    found = []
    for i, j in zip(start[first].tolist(), stop[first].tolist(), strict=True):
        own = raw[i:j]
        if (c := table.get(own)) is None:
            c = table[own] = counter.count(own.decode("utf-8").replace(" ", MARK))
        found.append(c)
    n, s = np.array([c[0] for c in found], np.int64), np.array([c[1] for c in found])
    tokens += np.bincount(row, weights=n[inverse], minlength=rows).astype(np.int64)
    score += np.bincount(row, weights=s[inverse], minlength=rows)
    return tokens, score


def count_tokens(docs: DataFrame, path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens, score)``, one row for each row of ``docs``.

    ``path`` names a vocabulary file (pieces and scores) that the driver reads; the tasks get its
    pieces. Null and empty texts have no tokens and score 0. A text of one very long segment is
    counted in one piece, in time and memory in proportion to it. Repeated rows give repeated
    results; extra columns are ignored; an empty table gives an empty one. Counts follow from pieces and scores as a unigram model,
    whatever model the file was made for.
    """
    docs = shared.only(docs, "doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(Unigram.from_file(path))
    text = F.when(F.length("text") > 0, F.concat(F.lit(" "), F.translate("text", MARK, " "))).alias("text")
    return docs.select("doc_id", text).mapInArrow(_counts(model), "doc_id long, n_tokens long, score double")
