r"""Repair of the structure of conversations at least cost, by Hirschberg's divide and conquer.

Rows of a conversation are kept (0), given another role (2) or deleted (3), and empty turns are inserted (2), so that the initials of
the roles that are left read ``(s?(ua)+)?``. An automaton of four states reads them: nothing yet, after s, after u, after a. A row, with the
inserts before it, is a table of costs from state to state; so is a run of rows.

1. The damaged rows are sorted by ranges of (conversation, turn, role, text), so that a conversation of any length is dealt over many
   tasks, and cut into segments of ``SEGMENT`` rows at most. Of each row a letter is left, which says its initial and its fault.
2. Each segment gives its cost table. The segments of a conversation are chained, and each gets its first and last state.
3. Inside a segment, the costs forward from its start and backward from its end meet in the middle. Of the cheapest crossings the one with
   the least audit is taken, and both halves are solved in the same way, in space that is linear in the rows.
4. The edits go back to the rows, and one pass over each conversation in order, held one batch at a time, hashes what is left.

An audit up to a row ends with that row's letter, so that of two different audits up to a row none is a prefix of the other. Which of
two states has the lesser audit is thus known without what follows, and a forward vector carries a rank beside each cost.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm import shared

#: Rows of a segment; a power of two.
SEGMENT = 1 << 16
#: Stretches of rows whose solution is remembered, since most conversations have the same few patterns.
SHORT = 64

START, SYSTEM, USER, ASSISTANT = range(4)
#: By initial (s, u, a, other) plus four times the fault (none, blank, duplicate, truncated).
LETTERS = "0123456789abcdef"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"

#: Where an inserted or reroled turn leads, by state, and its role.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: States from which the initials s, u and a can be read, and where they lead.
_READS = {0: ({START}, SYSTEM), 1: ({START, SYSTEM, ASSISTANT}, USER), 2: ({USER}, ASSISTANT)}
#: Cost and audit of what has to be inserted after the last row, by state.
TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}

#: ``table[s][e]`` is (cost, key) of the least way from s to e; keys of one s order the audits of its ways.
Table = Sequence[dict[int, tuple[int, object]]]


def _row_table(letter: str) -> Table:
    code = LETTERS.index(letter)
    initial, fault = code % 4, code // 4
    out: list[dict[int, tuple[int, object]]] = []
    for start in range(4):
        best: dict[int, tuple[int, object]] = {}
        state, inserts = start, 0
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = CUT_OFF * (fault == TRUNCATED)
                ways.append((_NEXT[state], REROLE + extra, "R"))
                if initial in _READS and state in _READS[initial][0]:
                    ways.append((_READS[initial][1], extra, "K"))
            for end, cost, edit in ways:
                way = (cost + INSERT * inserts, "I" * inserts + edit)
                if end not in best or way < best[end]:
                    best[end] = way
            state, inserts = _NEXT[state], inserts + 1
        out.append(best)
    return out


ROWS: dict[str, Table] = {letter: _row_table(letter) for letter in LETTERS}


def forward(tables: Iterable[Table], vector: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """(cost, rank of the audit) of each state after ``tables``, from those before."""
    for table in tables:
        best: dict[int, tuple] = {}
        for s, (cost, rank) in vector.items():
            for e, (more, key) in table[s].items():
                way = (cost + more, rank, key)
                if e not in best or way < best[e]:
                    best[e] = way
        ranks = {w: k for k, w in enumerate(sorted({w[1:] for w in best.values()}))}
        vector = {e: (w[0], ranks[w[1:]]) for e, w in best.items()}
    return vector


def backward(tables: Sequence[Table], vector: dict[int, int]) -> dict[int, int]:
    """The cost from each state before ``tables`` on, from those after."""
    for table in reversed(tables):
        before = {}
        for s in range(4):
            costs = [more + vector[e] for e, (more, _) in table[s].items() if e in vector]
            if costs:
                before[s] = min(costs)
        vector = before
    return vector


def crossings(tables: Sequence[Table], start: int, end: int) -> list[int]:
    """The state after each of ``tables`` on the cheapest way with the least audit."""
    if len(tables) <= 1:
        return [end] * len(tables)
    half = len(tables) // 2
    ahead, back = forward(tables[:half], {start: (0, 0)}), backward(tables[half:], {end: 0})
    middle = min((ahead[q][0] + back[q], ahead[q][1], q) for q in ahead if q in back)[2]
    return crossings(tables[:half], start, middle) + crossings(tables[half:], middle, end)


@functools.lru_cache(1 << 16)
def _short(letters: str, start: int, end: int) -> tuple[str, ...]:
    tables = [ROWS[x] for x in letters]
    ways = crossings(tables, start, end)
    return tuple(tables[k][s][e][1] for k, (s, e) in enumerate(zip([start, *ways], ways, strict=False)))


def edits(letters: str, start: int, end: int) -> list[str]:
    """The audit of each row, its inserts first, on the cheapest way from ``start`` to ``end`` with the least audit."""
    if len(letters) <= SHORT:
        return list(_short(letters, start, end))
    half = len(letters) // 2
    ahead = forward((ROWS[x] for x in letters[:half]), {start: (0, 0)})
    back = backward([ROWS[x] for x in letters[half:]], {end: 0})
    middle = min((ahead[q][0] + back[q], ahead[q][1], q) for q in ahead if q in back)[2]
    return edits(letters[:half], start, middle) + edits(letters[half:], middle, end)


@functools.lru_cache(1 << 16)
def _table(letters: str) -> Table:
    return [forward((ROWS[x] for x in letters), {s: (0, 0)}) for s in range(4)]


def summary(letters: str) -> Table:
    """The table of a run of rows; its keys are ranks."""
    return _table(letters) if len(letters) <= SHORT else _table.__wrapped__(letters)


def chain(tables: Sequence[Table]) -> tuple[int, list[int], str]:
    """(cost, state after each table, audit of what is inserted at the end) of a conversation."""
    last = forward(tables, {START: (0, 0)})
    cost, _, end = min((c + TAIL[e][0], rank, e) for e, (c, rank) in last.items())
    return cost, crossings(tables, START, end), TAIL[end][1]


# --- Rows --------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(cid, turn, role, text, copies) of ``rows(conv_id, turn, role, text)`` that aren't dropped; nulls of cid, role and text are one space."""
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), string("role").alias("role"), string("text").alias("text"))
    fate = F.crc32(F.concat_ws(":", string("conv_id"), string("turn")).cast("binary")) % 20
    return named.withColumn("fate", fate).where("fate <> 0").select(
        string("conv_id").alias("cid"), "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


ORDER = ("cid", "turn", "role", "digest")


def _ordered(left: DataFrame) -> DataFrame:
    """(cid, turn, role, digest, blank, open, at): every row without its text; ``at`` counts in the order of ORDER, without gaps inside a task's range."""
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    slim = left.select("cid", "turn", "role", _digest().alias("digest"), (end == "").alias("blank"), (~end.isin("", ".", "!", "?")).alias("open"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_"))
    sorted_ = slim.drop("_").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)  # nulls come first
    return shared.written(sorted_.withColumn("at", F.monotonically_increasing_id()))


def _segments(order: DataFrame) -> DataFrame:
    """(cid, seg, first, letters): one row for each SEGMENT rows of a conversation in a range at most."""
    first = order.where("not blank").groupBy("cid", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    rows = order.join(first, "at", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + 4 * fault
    letter = F.substring(F.lit(LETTERS), code + 1, F.lit(1))
    listed = F.array_sort(F.collect_list(F.struct("at", letter.alias("letter"))))
    grouped = rows.groupBy("cid", F.expr(f"at div {SEGMENT}").alias("seg")).agg(F.min("at").alias("first"), listed.alias("listed"))
    return shared.written(grouped.select("cid", "seg", "first", F.array_join(F.transform("listed", lambda x: x["letter"]), "").alias("letters")))


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _illegal(initials: Sequence[int]) -> int:
    return sum((a, b) not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _summaries(segments: DataFrame) -> DataFrame:
    """Of each segment: its table as (s, e, cost, rank) numbers, its first and last initial, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, rest = [], []
            for letters in batch.column("letters").to_pylist():
                table = summary(letters)
                flat.append([v for s, ways in enumerate(table) for e, (cost, rank) in ways.items() for v in (s, e, cost, rank)])
                codes = [LETTERS.index(x) for x in letters]
                faults, initials = [c // 4 for c in codes], [c % 4 for c in codes]
                rest.append((*(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), _illegal(initials), initials[0], initials[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("seg"), pa.array(flat, pa.list_(pa.int64())), *[pa.array([r[k] for r in rest], pa.int64()) for k in range(6)]],
                ["cid", "seg", "way", "blank", "duplicate", "truncated", "illegal", "head", "tail"],
            )

    return segments.select("cid", "seg", "letters").mapInArrow(run, "cid string, seg long, way array<long>, blank long, duplicate long, truncated long, illegal long, head long, tail long")


def _chains(summaries: DataFrame) -> DataFrame:
    """Of each conversation: counts, cost, the insertions at its end, and the states around each segment."""
    listed = F.array_sort(F.collect_list(F.struct("seg", "way", "head", "tail"))).alias("segs")
    grouped = summaries.groupBy("cid").agg(listed, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            between, costs, tails, plans = [], [], [], []
            for segs in batch.column("segs").to_pylist():
                tables = []
                for seg in segs:
                    table: list[dict] = [{} for _ in range(4)]
                    for k in range(0, len(seg["way"]), 4):
                        s, e, cost, rank = seg["way"][k : k + 4]
                        table[s][e] = (cost, rank)
                    tables.append(table)
                cost, states, tail = chain(tables)
                between.append(sum((a["tail"], b["head"]) not in _LEGAL for a, b in zip(segs, segs[1:], strict=False)))
                costs.append(cost)
                tails.append(tail)
                plans.append([{"seg": g["seg"], "s": s, "e": e} for g, s, e in zip(segs, [START, *states], states, strict=False)])
            same = [batch.column(c) for c in ("cid", "blank", "duplicate", "truncated", "illegal")]
            kind = pa.list_(pa.struct([("seg", pa.int64()), ("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*same, pa.array(between, pa.int64()), pa.array(costs, pa.int64()), pa.array(tails, pa.string()), pa.array(plans, kind)], ["cid", "blank", "duplicate", "truncated", "illegal", "between", "cost", "end", "plan"])

    return grouped.mapInArrow(run, "cid string, blank long, duplicate long, truncated long, illegal long, between long, cost long, end string, plan array<struct<seg:long,s:int,e:int>>")


def _audits(segments: DataFrame, chains: DataFrame) -> DataFrame:
    """(cid, seg, first, edits): the audit of every row of a segment."""
    plans = chains.select("cid", F.inline("plan"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [edits(x, s, e) for x, s, e in zip(*(batch.column(c).to_pylist() for c in ("letters", "s", "e")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("seg"), batch.column("first"), pa.array(found, pa.list_(pa.string()))], ["cid", "seg", "first", "edits"])

    return shared.written(segments.join(plans, ["cid", "seg"]).select("cid", "seg", "first", "letters", "s", "e").mapInArrow(run, "cid string, seg long, first long, edits array<string>"))


def _hashes(left: DataFrame, order: DataFrame, audits: DataFrame, chains: DataFrame) -> DataFrame:
    """(cid, repaired_sha256): texts and edits meet in the order of their rows, and are hashed as they pass.

    Equal rows need one text; their edits follow it.
    """
    edit = audits.select(F.posexplode("edits").alias("k", "edit"), "first").select((F.col("first") + F.col("k")).alias("at"), "edit")
    none = F.lit(None).cast("string")
    texts = left.select("cid", F.lit(0).alias("last"), "turn", "role", _digest().alias("digest"), F.lit(-1).cast("long").alias("at"), none.alias("edit"), "text")
    edited = order.join(edit, "at").select("cid", F.lit(0).alias("last"), "turn", "role", "digest", "at", "edit", none.alias("text"))
    ends = chains.where("end <> ''").select("cid", F.lit(1).alias("last"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("at"), F.col("end").alias("edit"), none.alias("text"))
    merged = texts.union(edited).union(ends)
    merged = shared.only(merged.repartition("cid").sortWithinPartitions("cid", "last", "turn", "role", "digest", "at"), "cid", "role", "edit", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, sha, state, lines = None, "", None, START, 0
        for batch in batches:
            done: list[tuple[str, str]] = []
            for cid, role, edit, new in zip(*(batch.column(c).to_pylist() for c in ("cid", "role", "edit", "text")), strict=True):
                if cid != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha, state, lines = cid, hashlib.sha256(), START, 0
                if edit is None:
                    text = new
                    continue
                for step in edit:
                    if step == "D":
                        continue
                    if step == "K":
                        own, state = role, _READS["sua".index(role[0])][1]
                    else:
                        state = _NEXT[state]
                        own = _ROLE[state]
                    line = f"{own}:{text if step != 'I' else ''}"
                    sha.update((line if not lines else "\n" + line).encode())
                    lines += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["cid", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["cid", "repaired_sha256"])

    return merged.mapInArrow(run, "cid string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``rows(conv_id, turn, role, text)``, which it damages first.

    A row for every conv_id, null included. Rows are ordered by turn, nulls first, ties by role and then by the digest of the text; a
    null role or text is one space. Roles count by their first letter, and an empty one has none of the three. Empty texts are
    blank; of equal rows all but the first are duplicates; very long texts stay whole, conversations of any length are cut into
    segments. An empty table gives no rows; other columns, whatever their names, go. Edits that tie in cost are taken so that the audit is
    ASCII-least.
    """
    left = damaged(rows)
    order = _ordered(left)
    segments = _segments(order)
    chains = shared.written(_chains(_summaries(segments)))
    audits = _audits(segments, chains)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.array_join("edits", "").alias("audit")))), lambda x: x["audit"]), "")
    audit = audits.groupBy("cid").agg(joined.alias("audit"))
    turns = order.where("turn is not null").select("cid", "turn").distinct().groupBy("cid").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    cid = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" "))
    out = rows.select(cid.alias("cid")).distinct()
    for part in (chains.drop("plan"), audit, turns, _hashes(left, order, audits, chains)):
        out = out.join(part, "cid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select(
        F.when(F.col("cid") != " ", F.col("cid")).cast("long").alias("conv_id"),
        *[zero(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")],
        zero(F.col("illegal") + F.col("between")).alias("illegal"),
        zero(F.col("cost")).alias("cost"),
        F.coalesce(F.concat("audit", "end"), F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _ways_sql(end: int) -> str:
    """All ways of one row into a state, in SQL: a start, inserts, an edit."""
    names = {1: "user", 2: "assistant"}
    lines = lambda steps: " || ".join([*(rf"chr(10) || '{names[x]}:'" for x in steps)]) or "''"
    after = {0: 1, 1: 1, 2: 2, 3: 1}  # the turn that may follow, as a role, by state: nothing, s, u, a
    state_of = {1: 2, 2: 3}
    ways = []
    for start in range(4):
        state, put = start, []
        for _ in range(3):
            base = f"v[{start + 1}]"
            head = f"{base}.r || {lines(put)}" if put else f"{base}.r"
            n = len(put)
            if state == end:
                ways.append((f"{base}.c + {3 + 2 * n}", f"{base}.a || '{'I' * n}D'", head))
            if state_of[after[state]] == end:
                cost = f"{base}.c + {2 + 2 * n} + CASE WHEN fault = 3 THEN 1 WHEN fault > 0 THEN 1000000000 ELSE 0 END"
                ways.append((cost, f"{base}.a || '{'I' * n}R'", rf"{head} || chr(10) || '{names[after[state]]}:' || text"))
            reads = {"s": (0,), "u": (0, 1, 3), "a": (2,)}["?sua"[end]] if end else ()
            if state in reads:
                cost = f"{base}.c + {2 * n} + CASE WHEN initial <> '{'?sua'[end]}' THEN 1000000000 WHEN fault = 3 THEN 1 WHEN fault > 0 THEN 1000000000 ELSE 0 END"
                ways.append((cost, f"{base}.a || '{'I' * n}K'", f"{head} || chr(10) || role || ':' || text"))
            put.append(after[state])
            state = state_of[after[state]]
    return "list_min([" + ", ".join(f"{{'c': {c}, 'a': {a}, 'r': {r}}}" for c, a, r in ways) + "])"


_NONE = "{'c': CAST(1000000000000 AS BIGINT), 'a': '', 'r': ''}"
_SPACES = r"[^\x20\x09-\x0D]"

ORACLE_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    (~list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [ord(x) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) & 4294967295) % 20 AS fate
  FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE fate <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
judged AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '{_SPACES}') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN regexp_extract(text, '({_SPACES})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ranked),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, [{{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}}, {_NONE}, {_NONE}, {_NONE}] AS v FROM (SELECT DISTINCT conv_id FROM judged)
  UNION ALL
  SELECT w.conv_id, j.i, [{_ways_sql(0)}, {_ways_sql(1)}, {_ways_sql(2)}, {_ways_sql(3)}] AS v
  FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1),
last_ AS (SELECT conv_id, arg_max(v, i) AS v FROM walk GROUP BY conv_id),
ended AS (SELECT conv_id, list_min([{{'c': v[1].c, 'a': v[1].a, 'r': v[1].r}}, {{'c': v[2].c + 4, 'a': v[2].a || 'II', 'r': v[2].r || chr(10) || 'user:' || chr(10) || 'assistant:'}},
    {{'c': v[3].c + 2, 'a': v[3].a || 'I', 'r': v[3].r || chr(10) || 'assistant:'}}, {{'c': v[4].c, 'a': v[4].a, 'r': v[4].r}}]) AS b FROM last_),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted c ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON d.conv_id IS NOT DISTINCT FROM e.conv_id
"""
