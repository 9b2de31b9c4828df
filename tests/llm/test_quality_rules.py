"""Quality rules: counts against a brute-force version, priors and verdicts of hosts, edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from covarium.llm import qualityrules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, again = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            again |= {p for i in starts for p in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(again))


def random_text(rng):
    small = ["a", "b", "é", "ü#", "$$", "日本"]
    parts = []
    for _ in range(rng.randrange(0, 60)):
        parts.append(rng.choice(small))
        parts.append(rng.choice([" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b"]))
    return rng.choice(["", "\n", " "]) + "".join(parts)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(300)] + [None, "", " \n\t", "\n", "x" * 50_000, "one two three four five six seven eight " * 2_000, "a\x1cb\x85c d"]
    rows = [(i, rng.choice(["h1", "h2", None]), t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string, n_words int")
    return dict((r[0], r[2]) for r in rows), qualityrules.judge(df).collect()


def test_counts_equal_brute_force(judged):
    texts, rows = judged
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in qualityrules._COUNTS) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[5] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_hash_collisions_do_not_merge_words():
    import numpy as np

    data = np.frombuffer(b"aabbaa", np.uint8)
    ids = qualityrules._classes(data, np.array([0, 2, 4]), np.array([2, 4, 6]), np.zeros(3, np.uint64))
    assert ids[0] == ids[2] != ids[1]


def test_prior_follows_the_scatter_of_hosts():
    n = [100] * 50
    even = [10] * 50
    wild = [0] * 40 + [50] * 10
    sums = lambda x: (sum(n), sum(x), sum(a * a / b for a, b in zip(x, n)), sum(b * b for b in n), len(n))
    assert qualityrules.prior(*sums(even)) == (0.1, qualityrules.STRONGEST)
    mean, strength = qualityrules.prior(*sums(wild))
    assert mean == 0.1 and strength < 10
    assert qualityrules.prior(0, 0, 0, 0, 0)[0] == 0.0


CLEAN = " ".join(f"word{chr(97 + i % 26)}{i} " for i in range(40))
#: Seven percent of symbols: within the usual limit, beyond the one of watched hosts.
BORDER = CLEAN + " " + "#" * 22
JUNK = CLEAN + " " + "#" * 120


def test_host_verdicts_reach_documents(spark):
    rows = [(i, "bad", JUNK) for i in range(95)] + [(100, "bad", CLEAN)]
    rows += [(200 + i, "watched", JUNK) for i in range(50)] + [(300 + i, "watched", CLEAN) for i in range(50)] + [(400, "watched", BORDER)]
    rows += [(1000 + 200 * h + i, f"good{h}", CLEAN) for h in range(20) for i in range(100)] + [(9000, "good1", BORDER), (9001, "good2", JUNK)]
    rows += [(9100, "single", JUNK), (9101, "single", CLEAN)]
    found = {r["doc_id"]: r for r in qualityrules.judge(spark.createDataFrame(rows, "doc_id long, host string, text string")).collect()}
    assert found[100]["host_rejected"] and not found[100]["kept"]
    assert found[300]["kept"] and not found[400]["kept"] and not found[200]["kept"]
    assert found[9000]["kept"] and found[1000]["kept"] and not found[9001]["kept"]
    assert found[9101]["kept"] and found[9101]["host_rate"] < 0.5  # one failure of two is shrunk


def test_empty_table_repeats_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, host string, text string")
    assert qualityrules.judge(empty).collect() == []
    rows = [(1, "h", CLEAN), (1, "h", CLEAN), (None, "h", CLEAN)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string").withColumn("kept", F.lit("x")).withColumn("_host", F.lit(1)).withColumn("n", F.lit(2))
    assert [r["kept"] for r in qualityrules.judge(df).collect()] == [True] * 3
