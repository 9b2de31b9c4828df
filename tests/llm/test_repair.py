"""Repair of conversations: against a search over all edit scripts, over segments of few rows, edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from covarium.llm import repair

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, lines) over all scripts, by a table of strings."""
    pattern = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    def inserted(table):
        for _ in range(3):
            for q, (c, a, lines) in list(table.items()):
                for x, to in pattern[q].items():
                    if x in names:
                        way = (c + 2, a + "I", [*lines, names[x] + ":"])
                        if to not in table or way < table[to]:
                            table[to] = way
        return table

    table = {0: (0, "", [])}
    for role, text, fault in rows:
        new = {}

        def offer(q, way, new=new):
            if q not in new or way < new[q]:
                new[q] = way

        for q, (c, a, lines) in inserted(table).items():
            offer(q, (c + 3, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            for x, to in pattern[q].items():
                if x in names:
                    offer(to, (c + 2 + extra, a + "R", [*lines, f"{names[x]}:{text}"]))
                if role[:1] == x:
                    offer(to, (c + extra, a + "K", [*lines, f"{role}:{text}"]))
        table = new
    table = inserted(table)
    return min(table[q] for q in (0, 3) if q in table)


def brute(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fate = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    found = {}
    for conv, turns in out.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        seen, judged, faults = set(), [], []
        for _, role, text in turns:
            solid = SPACE.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
            faults.append(fault)
        cost, audit, lines = cheapest(judged)
        numbers = {t[0] for t in turns if t[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def random_rows(rng, conversations, longest):
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(rng.randrange(longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "assistant", "tool", "", None, "User", "seer", "ape"])
            rows.append((conv, rng.choice([None, *range(12)]), role, rng.choice(["Yes.", "No", "a?", " \n", "", None, "Hm.\n\n", "x\x0b", "Ü", f"{rng.random()}."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def collected(df):
    rows = repair.repair(df).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("segment", [1 << 16, 4])
def test_equals_search_over_all_scripts(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = random_rows(random.Random(segment), 150, 14)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit("x")).withColumn("cid", F.lit(1)).repartition(5)
    assert collected(df) == brute(rows)


def test_long_conversation_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 128)
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"{t}", f"{t}!"])) for t in range(3_000)]
    assert collected(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_halves_meet_where_the_whole_does():
    rng = random.Random(9)
    for _ in range(200):
        letters = "".join(rng.choice(repair.LETTERS) for _ in range(rng.randrange(1, 200)))
        cost, states, _ = repair.chain([repair.ROWS[x] for x in letters])
        whole = repair.edits(letters, repair.START, states[-1])
        cuts = sorted(rng.sample(range(len(letters) + 1), min(3, len(letters))))
        parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)]) if b > a]
        again, ends, _ = repair.chain([repair.summary(p) for p in parts])
        joined = [x for p, s, e in zip(parts, [repair.START, *ends], ends) for x in repair.edits(p, s, e)]
        assert again == cost and joined == whole


def test_empty_table_copies_and_long_texts(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    keep = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(gone, 0, "user", "Hello."), (keep, 0, "user", "long " * 200_000 + "."), *[(keep, 1, "assistant", "Same.")] * 500]
    found = collected(spark.createDataFrame(rows, SCHEMA))
    assert found == brute(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[keep][6] == "KK" + "D" * 499
