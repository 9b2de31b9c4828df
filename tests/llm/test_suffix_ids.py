"""Repeated text under ids that several documents share, and under very large ids."""

import random

from covarium.llm import suffixes


def test_shared_and_large_ids(spark):
    rng = random.Random(4)
    block = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
    rows = [((1 << 62) + 5, "z" + block), (1, "first text of one"), (1, block + " and more"), (-(1 << 62), "nothing"), (None, block)]
    found = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {((1 << 62) + 5, 301): 300, (1, 17): 0, (1, 309): 0, (-(1 << 62), 7): 0, (None, 300): 0}
