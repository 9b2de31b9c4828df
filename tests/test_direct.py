"""Direct information from an inverse in strips, against NumPy."""

import numpy as np
import pytest

from covarium.operators import blocks, dca, freq

LETTERS = 20


def random_alignment(spark, n, length, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.choice(list("ACDEFGHIKLMNPQRSTVWY-"), length)
    seqs = ["".join(np.where(rng.random(length) < 0.5, rng.choice(list("ACDEFGHIKLMNPQRSTVWY-"), length), base)) for _ in range(n)]
    return seqs, spark.createDataFrame([(k, str(k), s) for k, s in enumerate(seqs)], "seq_id long, hd string, seq string")


def correlations(seqs, regularise):
    x = blocks.one_hot(blocks.codes_of(seqs), dtype=float)
    share, f1, q = x.T @ x / len(x), x.mean(axis=0), 1 / 21
    back = np.full(share.shape, q * q)
    for k in range(len(seqs[0])):
        here = slice(k * LETTERS, (k + 1) * LETTERS)
        back[here, here] = np.eye(LETTERS) * q
    return (1 - regularise) * (share - np.outer(f1, f1)) + regularise * (back - q * q), ((1 - regularise) * f1 + regularise * q).reshape(-1, LETTERS)


def pair(j_block, fi, fj):
    """One pair by itself."""
    w = np.ones((21, 21))
    w[:20, :20] = np.exp(j_block)
    pi, pj = np.append(fi, 1 - fi.sum()), np.append(fj, 1 - fj.sum())
    a = b = np.full(21, 1 / 21)
    while True:
        new_a = pi / (w @ b)
        new_a /= new_a.sum()
        new_b = pj / (new_a @ w)
        new_b /= new_b.sum()
        moved = max(np.abs(new_a - a).max(), np.abs(new_b - b).max())
        a, b = new_a, new_b
        if moved < 1e-4:
            break
    p = w * np.outer(a, b)
    p /= p.sum()
    return float((p * np.log((p + 1e-100) / (np.outer(pi, pj) + 1e-100))).sum())


@pytest.mark.parametrize("tile", [64 << 20, 200_000])
def test_strips_equal_numpy(spark, monkeypatch, tile):
    monkeypatch.setattr(freq, "TILE_BYTES", tile)  # sums in place, and in tiles of few positions
    monkeypatch.setattr(dca, "STRIP_BYTES", 7 * LETTERS * 24 * LETTERS * 8)  # seven positions; the last strip has fewer
    monkeypatch.setattr(dca, "PAIRS", 5)
    seqs, msa = random_alignment(spark, 90, 24)
    c, f = correlations(seqs, 0.5)
    counts = freq.collected(msa)
    strips = dca.strips_of(freq._gram_parts(msa, None, counts), counts, 7, 0.5)
    assert strips.count() == 4
    held = {r["strip"]: np.frombuffer(r["block"]).reshape(-1, 480) for r in dca.inverse(strips, 480, 140).collect()}
    want = np.linalg.inv(c)
    assert np.allclose(np.concatenate([held[k] for k in range(4)]), want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
    got = {(r["i"], r["j"]): r["di"] for r in dca.direct_information(msa).collect()}
    assert len(got) == 24 * 23 // 2
    for (i, j), di in got.items():
        assert di == pytest.approx(pair(-want[i * 20 : i * 20 + 20, j * 20 : j * 20 + 20], f[i], f[j]), abs=1e-9)


def test_more_positions_than_one_strip_holds(spark, monkeypatch):
    """No task gets more than two strips, whatever the number of positions; the inverse is checked by its definition."""
    monkeypatch.setattr(dca, "STRIP_BYTES", 4 << 20)
    seqs, msa = random_alignment(spark, 40, 110, 1)
    counts = freq.collected(msa)
    n = 110 * LETTERS
    per = dca.STRIP_BYTES // (LETTERS * n * 8)
    assert 1 < per < 110
    c, _ = correlations(seqs, 0.5)
    found = dca.inverse(dca.strips_of(freq._gram_parts(msa, None, counts), counts, per, 0.5), n, per * LETTERS).orderBy("strip").collect()
    assert max(len(r["block"]) for r in found) <= dca.STRIP_BYTES
    assert np.abs(np.concatenate([np.frombuffer(r["block"]).reshape(-1, n) for r in found]) @ c - np.eye(n)).max() < 1e-8
    assert dca.direct_information(msa.limit(0)).collect() == []
