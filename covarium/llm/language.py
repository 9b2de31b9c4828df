"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed by it into phrases,
each the longest match from where the last ended (Ziv, Merhav 1993). A phrase is a place in a sample,
and every language is charged the same for one, ``log2`` of the longest sample, whatever the length of
its own: the language that needs the fewest phrases a letter wins. A short sample has shorter matches, so that it
takes texts from a longer one only where it parses them in fewer phrases. Charging it for its own length would
make a phrase of a sample of two letters cost one bit, and any text cheapest there.

Automata come from at most ``SAMPLE`` letters of a language, taken from documents in a seeded order;
this bound is a parameter. Texts are parsed whole. All blocks of ``BLOCK`` letters of a chunk step together, each at first as if
a phrase started with it; then the parse of the block before enters it, and its phrases are counted anew up to
the letter from which both parses are in the same state. Where they stay apart to the block's end, the next block follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm import shared

SAMPLE = 32_768
SAMPLE_DOCS = 48
BLOCK = 1024
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with every run of non-letters as one space, and the new offsets. Text is lower-case already."""
    data = np.where(_LETTERS[data], data, np.uint8(32))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], total[offsets]


class Automata:
    """Suffix automata of several languages in one transition table; state * width indexes it."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.langs = sorted(samples, key=lambda x: (-len(samples[x]), x))  # so that ties go to the longest sample
        seen = sorted(set(b"".join(samples.values())))
        self.width = len(seen) + 1
        self.code = np.zeros(256, np.uint8)  # 0: a byte that no sample has
        self.code[seen] = np.arange(1, len(seen) + 1)
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            t = self._suffix_automaton(self.code[np.frombuffer(samples[lang], np.uint8)].tolist())
            grid = np.full((len(t), self.width), -1, np.int32)
            for state, edges in enumerate(t):
                for c, to in edges.items():
                    grid[state, c] = (base + to) * self.width
            tables.append(grid.ravel())
            self.roots.append(base * self.width)
            base += len(t)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.bits = float(np.log2(max([2, *map(len, samples.values())])))

    @staticmethod
    def _suffix_automaton(text: list[int]) -> list[dict[int, int]]:
        """Transitions of the minimal automaton of all substrings (Blumer et al. 1985)."""
        edges: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(edges)
                    edges.append(edges[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        return edges

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each row of squeezed bytes needs in each language: (rows, languages)."""
        rows, k = len(offsets) - 1, len(self.langs)
        blocks = -(-np.diff(offsets) // BLOCK)
        last = np.cumsum(blocks) - 1
        row = np.repeat(np.arange(rows), blocks)
        within = np.arange(len(row)) - (last - blocks + 1)[row]
        start = offsets[:-1][row] + within * BLOCK
        long = np.minimum(start + BLOCK, offsets[1:][row]) - start
        roots = np.array(self.roots, np.int32)
        count, end = self._from_roots(data, start, long)
        entry = np.tile(roots, (len(row), 1))
        at, lang = np.nonzero((end[:-1] != roots) & (within[1:, None] > 0))
        at += 1
        while len(at):
            new = end[at - 1, lang]
            more, state, met = self._entered(data, start[at], long[at], entry[at, lang], new, roots[lang])
            count[at, lang] += more
            entry[at, lang] = new
            far = ~met & (state != end[at, lang])
            at, lang = at[far], lang[far]
            end[at, lang] = state[far]
            at = at + 1
            goes_on = at < len(row)
            goes_on[goes_on] = within[at[goes_on]] > 0
            at, lang = at[goes_on], lang[goes_on]
        out = np.zeros((rows, k), np.int64)
        np.add.at(out, row, count)
        some = np.flatnonzero(blocks > 0)
        out[some] += end[last[some]] != roots
        return out

    def _from_roots(self, data: np.ndarray, start: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end inside each block if one starts with it, and the states at its end: both (blocks, languages)."""
        k = len(self.langs)
        counts, ends = np.zeros((len(start), k), np.int64), np.zeros((len(start), k), np.int32)
        order = np.argsort(-long, kind="stable")
        lanes = 1024
        for a in range(0, len(order), lanes):  # equal lengths together: few lanes end early
            own = order[a : a + lanes]
            s, n = start[own], long[own]
            root = np.tile(np.array(self.roots, np.int32), (len(s), 1))
            state, count = root.copy(), np.zeros((len(s), k), np.int32)
            active = len(s) - np.searchsorted(n[::-1], np.arange(int(n[0])), side="right")
            grid = self.code[data[np.minimum(s[None, :] + np.arange(int(n[0]))[:, None], len(data) - 1)]].astype(np.int32)
            for t in range(int(n[0])):
                m = active[t]
                c = grid[t, :m, None]
                st, ro = state[:m], root[:m]
                to = self.table.take(st + c)
                miss = np.flatnonzero(to.ravel() < 0)
                if len(miss):
                    flat_to, flat_state, flat_root, flat_count = to.ravel(), st.ravel(), ro.ravel(), count[:m].reshape(-1)
                    again = self.table.take(flat_root[miss] + c.ravel()[miss // k])
                    lost = again < 0
                    flat_count[miss] += (flat_state[miss] != flat_root[miss]).astype(np.int32) + lost
                    flat_to[miss] = np.where(lost, flat_root[miss], again)
                state[:m] = to
            counts[own], ends[own] = count, state
        return counts, ends

    def _entered(self, data, start, long, old, new, root) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of a block and a language: how many more phrases end inside it from state ``new`` than from ``old``, the state
        at its end from ``new``, and whether both parses met (then it is the one from ``old``, and is not worked out)."""
        states, more = np.stack([old, new]), np.zeros(len(start), np.int64)
        live, t = np.arange(len(start)), 0
        while len(live):
            c = self.code[data[start[live] + t]].astype(np.int32)
            own, base = states[:, live], root[live]
            to, again = self.table.take(own + c), self.table.take(base + c)
            ended = np.where(to < 0, (own != base).astype(np.int64) + (again < 0), 0)
            more[live] += ended[1] - ended[0]
            states[:, live] = np.where(to < 0, np.where(again < 0, base, again), to)
            t += 1
            live = live[(states[0, live] != states[1, live]) & (t < long[live])]
        return more, states[1], states[0] == states[1]


def _predict(samples):
    def run(batches):
        automata = Automata(samples.value)
        k = len(automata.langs)
        for batch in batches:
            data, offsets = shared.utf8(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in shared.row_chunks(offsets, 4 << 20):
                n = b - a
                part, at = squeeze(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cost = np.zeros((n, max(k, 1)))
                if k and len(part):
                    cost = automata.phrases(part, at) * automata.bits / np.maximum(np.diff(at), 1)[:, None]
                best = cost.argmin(axis=1)
                ranked = np.sort(cost, axis=1)
                second = ranked[:, 1] if k > 1 else np.full(n, np.inf)
                score = np.where(second > 0, 1 - ranked[:, 0] / np.maximum(second, 1e-12), 0.0)
                known = letters[a:b] & (k > 0)
                lang = [automata.langs[j] if ok else "und" for j, ok in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(3).slice(a, n), pa.array(lang, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def sample_texts(docs: DataFrame, limit: int = SAMPLE, per_lang: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """At most ``limit`` letters of each language of ``docs(text, lang, order)``.

    They come from about ``per_lang`` documents, or from as many more as three times ``limit`` letters take. ``order``
    is a seeded 64-bit hash. Languages are counted first, then each is thinned by its own
    rate, so that what reaches the driver is bounded by the number of languages, not of documents.
    """
    docs = docs.where("lang is not null and length(text) > 0")
    size = F.least(F.length("text"), F.lit(limit))
    rate = {r["lang"]: max(per_lang / r["n"], 3 * limit / r["size"]) for r in docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("size")).collect()}
    if not rate:
        return {}
    share = F.create_map(*[x for lang, r in rate.items() for x in (F.lit(lang), F.lit(min(1.0, float(r))))])
    chance = F.pmod("order", F.lit(1 << 40)) / float(1 << 40)
    rows = docs.where(chance < share[F.col("lang")]).select("lang", "order", F.substring(F.lower("text"), 1, limit).alias("text")).orderBy("lang", "order").collect()
    out: dict[str, bytes] = {}
    for r in rows:
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        had = out.get(r["lang"], b"")
        out[r["lang"]] = (had + squeeze(raw, np.array([0, len(raw)]))[0].tobytes())[:limit]
    return out


def identify(docs: DataFrame, held_out=None, limit: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, lang)`` to ``(doc_id, held_out, lang_pred, score)``, one row for each row of ``docs``.

    Only rows with a language for which ``held_out`` (a Boolean column; by default the checksum of
    doc_id is a multiple of 5) is false are learned from, and only their text and lang. A null text or one
    without letters is ``und`` with score 0, as is all if nothing could be learned. ``score`` is one
    less the ratio of the best to the second-best normalised phrase count (1 for a lone language);
    equal counts go to the language with the longest sample, then to the first in alphabetical order. A language of
    which only a few hundred letters are known is learned but seldom predicted, and takes no texts from others.
    Rows without doc_id are not learned from and count as not held out. Very long texts are parsed whole; repeated rows
    give repeated results. Extra columns are ignored; an empty table gives an empty one.
    """
    shared.narrow_batches(docs.sparkSession)
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    learn = rows.where("not held_out").select("text", "lang", F.xxhash64(F.lit(7), "doc_id").alias("order"))
    samples = docs.sparkSession.sparkContext.broadcast(sample_texts(learn, limit))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return rows.select("doc_id", F.lower("text").alias("text"), letters, F.coalesce("held_out", F.lit(False)).alias("held_out")).mapInArrow(_predict(samples), "doc_id long, held_out boolean, lang_pred string, score double")
