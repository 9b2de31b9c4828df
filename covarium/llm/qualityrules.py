"""Quality rules of documents, and verdicts on their hosts.

1. One pass over the texts counts, in Arrow batches, what the rules need: words, their code points, symbols, lines,
   repeated lines, and words in repeated 8-word windows. Hashes find equal words, windows and lines; every equality is
   confirmed on the bytes, so counts are exact.
2. Rule failures are summed by host (combined on the map side), and for each rule the hosts give a beta prior: its mean is the
   failure rate of all documents, its strength follows from how far the hosts' rates scatter beyond chance (the moment estimate
   of a beta-binomial, Kleinman 1973). A host's rate is shrunk to (x + mean * strength) / (n + strength).
3. The verdicts go back to the documents. Where a host's shrunk rate of a rule is above ``WATCH``, its documents are held against
   that rule's stricter limit; a host whose shrunk rate of any failure is above ``REJECT`` loses all its documents.

A document is kept if it passes the base rules, all rules at the limit that its host has, and its host isn't rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm import shared

#: Words of a window; the shortest text; the most percent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Percent of symbols to the code points of words, and of lines that repeat one: the usual limit and the one of watched hosts.
SYMBOLS, LINES = (10, 5), (50, 30)
#: Code points a word, of texts with LEAST_WORDS: the usual limits and those of watched hosts.
SHORT_WORDS, LONG_WORDS = (2, 3), (12, 10)
#: Shrunk rates: above the first a host is watched for a rule, above the second it is rejected.
WATCH, REJECT = 0.3, 0.8
#: The prior counts as so many documents at least and at most.
WEAKEST, STRONGEST = 1, 1_000

RULES = ("symbols", "lines", "lengths")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from ``a`` on equal those from ``b`` on, for each pair."""
    end = np.cumsum(size)
    own = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size, size)
    bad = data[np.repeat(a, size) + own] != data[np.repeat(b, size) + own]
    out = np.ones(len(a), bool)
    out[np.repeat(np.arange(len(a)), size)[bad]] = False
    return out


def _classes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each byte string, the same for equal ones alone."""
    size = stops - starts
    order = np.lexsort((size, hashes))
    a, b = order[:-1], order[1:]
    same = (hashes[a] == hashes[b]) & (size[a] == size[b])
    equal = same.copy()
    equal[same] = _same_bytes(data, starts[a[same]], starts[b[same]], size[a[same]])
    out = np.empty(len(starts), np.int64)
    if (equal == same).all():
        out[order] = np.concatenate([[0], np.cumsum(~same)]) if len(order) else 0
        return out
    seen: dict[bytes, int] = {}  # two strings with one hash
    for k, (s, e) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        out[k] = seen.setdefault(data[s:e].tobytes(), len(seen))
    return out


def _windows(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which words lie in a window that occurs twice or more in their row."""
    n = len(ids) - WINDOW + 1
    inside = np.zeros(len(ids), bool)
    if n < 2:
        return inside
    start = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    key = row[start].astype(np.uint64)
    for k in range(WINDOW):
        key = shared.mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids[start + k].astype(np.uint64))
    order = np.lexsort((start, key))
    start, key = start[order], key[order]
    pair = np.flatnonzero(key[1:] == key[:-1])
    a, b = start[pair], start[pair + 1]
    fits = row[a] == row[b]
    for k in range(WINDOW):
        fits &= ids[a + k] == ids[b + k]
    if not fits.all():  # two windows with one key
        columns = np.stack([row[start], *[ids[start + k] for k in range(WINDOW)]], axis=1)
        _, group, count = np.unique(columns, axis=0, return_inverse=True, return_counts=True)
        found = start[count[group.ravel()] > 1]
    else:
        found = np.concatenate([a, b])
    edge = np.zeros(len(ids) + 1, np.int64)
    found = np.unique(found)
    edge[found] += 1
    edge[found + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def counts(texts: pa.Array) -> pa.RecordBatch:
    """The counts of each text; null counts as empty."""
    data, offsets = shared.utf8(texts)
    out = np.zeros((len(_COUNTS), len(offsets) - 1), np.int64)
    for first, last in shared.row_chunks(offsets):
        own, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        rows = last - first
        starts, stops, row, hashes = shared.words(own, at, lower=False)
        tally = lambda which, weights=None: np.bincount(which, weights=weights, minlength=rows).astype(np.int64)
        heads = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        symbols = np.flatnonzero(_SYMBOL[own])
        ids = _classes(own, starts, stops, hashes)
        # Lines end before each \n and at the end of each text.
        breaks = np.flatnonzero(own == 10)
        begin = np.unique(np.concatenate([at[:-1], breaks + 1]))
        begin = begin[begin < len(own)]
        end = np.minimum(np.concatenate([begin[1:], [len(own)]]), at[np.searchsorted(at, begin, side="right")]) if len(begin) else begin
        end = end - ((end > begin) & (own[np.maximum(end - 1, 0)] == 10))
        worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        begin, end = begin[worded], end[worded]
        where = np.searchsorted(at, begin, side="right") - 1
        lines = _classes(own, begin, end, shared._WORDS.of(shared._WORDS.prefix(own), begin, end))
        firsts = np.unique(np.stack([where, lines]), axis=1)[0] if len(begin) else begin
        many = tally(where)
        out[:, first:last] = (
            tally(row), tally(row, heads[stops] - heads[starts]), tally(np.searchsorted(at, symbols, side="right") - 1), many, many - tally(firsts), tally(row[_windows(row, ids)]),
        )
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], list(_COUNTS))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, host, and the counts of ``text``) of ``docs(doc_id, host, text)``; other columns go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *found.columns], ["doc_id", "host", *_COUNTS])

    rows = shared.only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("host").cast("string").alias("host"), F.col("text").cast("string").alias("text")), "doc_id", "host", "text")
    return rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def failed(rule: str, strict: int = 0) -> Column:
    """Whether a document breaks a rule at its usual limit, or at the one of watched hosts."""
    if rule == "symbols":
        return 100 * F.col("n_symbols") > SYMBOLS[strict] * F.col("word_chars")
    if rule == "lines":
        return 100 * F.col("n_dup_lines") > LINES[strict] * F.col("n_lines")
    per = F.col("n_words")
    return (per >= LEAST_WORDS) & ((F.col("word_chars") < SHORT_WORDS[strict] * per) | (F.col("word_chars") > LONG_WORDS[strict] * per))


def prior(n: float, x: float, scatter: float, squares: float, hosts: int) -> tuple[float, float]:
    """Mean and strength of the beta prior, from sums over hosts: of n, of x, of x * x / n, of n * n, and their number."""
    if not n:
        return 0.0, float(STRONGEST)
    mean = x / n
    spread, room = mean * (1 - mean), n - squares / n - (hosts - 1)
    if spread <= 0 or room <= 0:
        return mean, float(STRONGEST)
    rho = ((scatter - n * mean * mean) / spread - (hosts - 1)) / room
    rho = min(max(rho, 1 / (STRONGEST + 1)), 1 / (WEAKEST + 1))
    return mean, 1 / rho - 1


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, host_rate, host_rejected) of ``docs(doc_id, host, text)``, a row for each row.

    Null and empty texts have no words and fail; null hosts are one host; rows without doc_id and repeated rows are
    judged like all others, each counting for its host; an empty table gives no rows; other columns, whatever their names, go.
    """
    rows = shared.written(measure(docs)).withColumn("base_failed", base_failed())
    any_failed = F.col("base_failed")
    for rule in RULES:
        any_failed = any_failed | failed(rule)
    hits = {"any": any_failed} | {rule: failed(rule) for rule in RULES}
    hosts = shared.written(rows.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(hit.cast("long")).alias(f"x_{k}") for k, hit in hits.items()]))
    sums = hosts.agg(
        F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.count("*").alias("hosts"),
        *[F.sum(f"x_{k}").alias(f"x_{k}") for k in hits], *[F.sum(F.col(f"x_{k}").cast("double") * F.col(f"x_{k}") / F.col("n")).alias(f"q_{k}") for k in hits],
    ).first()  # a row, whatever the corpus
    rates = {}
    for k in hits:
        mean, strength = prior(sums["n"] or 0, sums[f"x_{k}"] or 0, sums[f"q_{k}"] or 0, sums["squares"] or 0, sums["hosts"])
        rates[k] = (F.col(f"x_{k}") + mean * strength) / (F.col("n") + strength)
    verdicts = hosts.select(F.col("host").alias("_host"), F.round(rates["any"], 6).alias("host_rate"), (rates["any"] > REJECT).alias("host_rejected"), *[(rates[r] > WATCH).alias(f"watch_{r}") for r in RULES])
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host")))
    broken = F.lit(False)
    for rule in RULES:
        broken = broken | failed(rule) | (F.col(f"watch_{rule}") & failed(rule, 1))
    return joined.select("doc_id", *_COUNTS, "base_failed", (~(F.col("base_failed") | broken | F.col("host_rejected"))).alias("kept"), "host_rate", "host_rejected")


_RATES = ", ".join(
    f"""(x_{k} + m_{k} * s_{k}) / (n + s_{k}) AS r_{k}""" for k in ("any", *RULES)
)
_PRIORS = ", ".join(
    f"""m_{k}, CASE WHEN m_{k} * (1 - m_{k}) > 0 AND nn - squares / nn - (hosts - 1) > 0 THEN
      1 / least(greatest(((q_{k} - nn * m_{k} * m_{k}) / (m_{k} * (1 - m_{k})) - (hosts - 1)) / (nn - squares / nn - (hosts - 1)), 1.0 / {STRONGEST + 1}), 1.0 / {WEAKEST + 1}) - 1 ELSE {STRONGEST} END AS s_{k}"""
    for k in ("any", *RULES)
)


def _rule_sql(strict: int) -> dict[str, str]:
    return {
        "symbols": f"100 * n_symbols > {SYMBOLS[strict]} * word_chars",
        "lines": f"100 * n_dup_lines > {LINES[strict]} * n_lines",
        "lengths": f"n_words >= {LEAST_WORDS} AND (word_chars < {SHORT_WORDS[strict]} * n_words OR word_chars > {LONG_WORDS[strict]} * n_words)",
    }


_USUAL, _STRICT = _rule_sql(0), _rule_sql(1)

ORACLE_SQL = rf"""
WITH raw AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM raw),
wins AS (SELECT k, unnest(range(1, len(w) - {WINDOW - 2})) AS i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM split WHERE len(w) >= {WINDOW}),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM wins) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY k),
counted AS (
  SELECT k, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (k)),
ruled AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {", ".join(f"({v}) AS f_{r}" for r, v in _USUAL.items())}, {", ".join(f"({v}) AS t_{r}" for r, v in _STRICT.items())} FROM counted),
marked AS (SELECT *, base_failed OR {" OR ".join(f"f_{r}" for r in RULES)} AS f_any FROM ruled),
hosts AS (SELECT host, count(*) AS n, {", ".join(f"CAST(sum(CAST(f_{k} AS INTEGER)) AS DOUBLE) AS x_{k}" for k in ("any", *RULES))} FROM marked GROUP BY host),
sums AS (SELECT CAST(sum(n) AS DOUBLE) AS nn, sum(CAST(n AS DOUBLE) * n) AS squares, count(*) AS hosts, {", ".join(f"sum(x_{k}) / sum(n) AS m_{k}, sum(x_{k} * x_{k} / n) AS q_{k}" for k in ("any", *RULES))} FROM hosts),
priors AS (SELECT {_PRIORS} FROM sums),
rates AS (SELECT host, {_RATES} FROM hosts, priors)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  NOT (f_any OR r_any > {REJECT} OR {" OR ".join(f"(r_{r} > {WATCH} AND t_{r})" for r in RULES)}) AS kept, round(r_any, 6) AS host_rate, r_any > {REJECT} AS host_rejected
FROM marked JOIN rates ON marked.host IS NOT DISTINCT FROM rates.host
"""
