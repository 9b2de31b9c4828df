"""Secret scans by a trigram inverted index.

For each rule's regular expression a Boolean trigram query is derived (Cox, "Regular Expression
Matching with a Trigram Index", 2012): a text that matches must satisfy it. Each batch of documents
is an index segment: the postings of just those trigrams that occur in some query. Intersecting and
uniting postings gives the candidates, and only these meet the regular expression. A rule whose
query is empty ("any text may match") scans all documents of the segment.

Segments are local to a task, so nothing is shuffled and nothing grows with the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm import shared

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python 3.10
    import sre_constants as _c
    import sre_parse as _p

#: A query is True (any text), a trigram, or ("and" | "or", frozenset of queries).
Query = object

_MOST_STRINGS, _MOST_CLASS = 64, 8


def _all(parts: Iterable[Query]) -> Query:
    flat: set = set()
    for q in parts:
        if isinstance(q, tuple) and q[0] == "and":
            flat |= q[1]
        elif q is not True:
            flat.add(q)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(parts: Iterable[Query]) -> Query:
    flat = set(parts)
    if True in flat or not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of_strings(strings: set[str] | None) -> Query:
    """What holds if one of the strings occurs."""
    if not strings or min(map(len, strings)) < 3:
        return True
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is _c.LITERAL:
        return {chr(arg).lower()}, True
    if op is _c.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is _c.LITERAL:
                chars.add(chr(value).lower())
            elif kind is _c.RANGE and value[1] - value[0] < _MOST_CLASS:
                chars |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= _MOST_CLASS else (None, True)
    if op is _c.SUBPATTERN:
        return _sequence(arg[-1])
    if op is _c.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        strings = None if any(e is None for e, _ in found) else set().union(*(e for e, _ in found))
        return strings, _any(_all([q, _of_strings(e)]) for e, q in found)
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and high == 1:
            return (strings | {""} if low == 0 else strings), (query if low else True)
        if low == 0:
            return None, True
        if strings is not None and low == high and len(strings) ** low <= _MOST_STRINGS:
            return {"".join(x) for x in product(strings, repeat=low)}, query
        return None, _all([query, _of_strings(strings)])
    if op is _c.AT:
        return {""}, True
    return None, True


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """Like _node for a sequence: runs of few strings are joined before their trigrams are taken."""
    run: set[str] = {""}
    whole, must = True, []
    for op, arg in nodes:
        strings, query = _node(op, arg)
        must.append(query)
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
        else:
            whole = False
            must.append(_of_strings(run))
            run = strings if strings is not None else {""}
    if whole:
        return run, _all(must)
    return None, _all([*must, _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that every match of ``pattern`` satisfies."""
    strings, query = _sequence(_p.parse(pattern))
    return _all([query, _of_strings(strings)])


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(x) for x in query[1]))


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` must have at least ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    #: Same matches as ``pattern`` after the length test, but found faster; "" if none.
    fast: str = ""
    query: Query = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "query", trigram_query(self.pattern))


def _either(word: str) -> str:
    """A pattern for the word with each ASCII letter in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The kinds, their patterns and least lengths.
RULES = (
    Rule(
        "assign",
        "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        base=True,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", "[0-9a-f]+", least=24, base=True, fast="[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_login", r"[a-z]{3,10}://[A-Za-z0-9._-]{1,64}:[^\s:@/]{3,64}@"),
)


class Segment:
    """The inverted index of a batch: postings of the wanted trigrams, as sorted row numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: set[str]) -> None:
        self.rows = np.arange(len(offsets) - 1)
        self.postings: dict[str, np.ndarray] = {}
        codes = {t: int.from_bytes(b, "big") for t in wanted if len(b := t.encode()) == 3}
        self.unindexed = wanted - codes.keys()
        low = shared._LOWER[data].astype(np.uint32)
        if len(low) < 3 or not codes:
            self.postings = {t: self.rows[:0] for t in codes}
            return
        grams = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        table = np.zeros(1 << 24, bool)
        table[list(codes.values())] = True
        at = np.flatnonzero(table[grams])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[1:][row]
        row, gram = row[inside], grams[at[inside]]
        for t, code in codes.items():
            self.postings[t] = np.unique(row[gram == code])

    def find(self, query: Query) -> np.ndarray:
        """Rows that satisfy the query."""
        if query is True or query in self.unindexed:
            return self.rows
        if isinstance(query, str):
            return self.postings[query]
        found = [self.find(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        for x in sorted(found, key=len)[1:]:
            found[0] = np.intersect1d(min(found, key=len), x, assume_unique=True)
        return min(found, key=len)


def spans_of(rules: tuple[Rule, ...], compiled: list[re.Pattern], text: str, which: Iterable[int]) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of every match, leftmost and non-overlapping for each rule."""
    out = []
    for k in which:
        rule = rules[k]
        for m in compiled[k].finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def _scanner(rules: tuple[Rule, ...]):
    def run(batches):
        compiled = [re.compile(r.fast or r.pattern) for r in rules]
        wanted = set().union(*(trigrams_of(r.query) for r in rules))
        for batch in batches:
            data, offsets = shared.utf8(batch.column(1))
            texts = batch.column(1)
            n = batch.num_rows
            which: list[list[int]] = [[] for _ in range(n)]
            for a, b in shared.row_chunks(offsets):
                segment = Segment(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], wanted)
                for k, rule in enumerate(rules):
                    for i in segment.find(rule.query).tolist():
                        which[a + i].append(k)
            rows = [spans_of(rules, compiled, texts[i].as_py() or "", which[i]) if which[i] else [] for i in range(n)]
            spans = [[{"kind": rules[k].kind, "start": s, "stop": e, "base": rules[k].base} for s, k, e in row] for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS_ARROW)], ["doc_id", "spans"])

    return run


_SPANS = "array<struct<kind:string,start:long,stop:long,base:boolean>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, spans)``, one row for each row of ``docs``.

    ``spans`` lists kind, start and end (code points, end exclusive) of every finding, by start and
    then in the rules' order. Null and empty texts have none. Texts of any length are scanned whole; findings that start at one
    place all count. Repeated rows give repeated results; extra columns are ignored; an empty table gives an empty one.
    """
    return shared.only(docs, "doc_id", "text").mapInArrow(_scanner(rules), f"doc_id long, spans {_SPANS}")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(r.kind) for r in rules if r.base),
        F.sha2(listed(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _redactor(rules: tuple[Rule, ...], column: int):
    scanner = _scanner(rules)

    def run(batches):
        for batch in batches:
            for found in scanner(iter([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(column)], ["doc_id", "text"])])):
                texts = []
                for text, spans in zip(batch.column(column).to_pylist(), found.column(1).to_pylist(), strict=True):
                    if spans:
                        out, at = [], 0
                        for s in spans:
                            if s["start"] >= at:
                                out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                            at = max(at, s["stop"])
                        text = "".join([*out, text[at:]])
                    texts.append(text)
                columns = list(batch.columns)
                columns[column] = pa.array(texts, batch.column(column).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``[KIND]``; overlapping findings become one. Other columns stay, of any name.

    Null texts stay null and empty ones empty; repeated rows give repeated results; an empty table gives an empty one.
    """
    shared.narrow_batches(docs.sparkSession)
    return docs.mapInArrow(_redactor(rules, docs.columns.index("text")), docs.schema)
