"""Exact quantiles, ranks and contacts against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covarium.functions import quantiles
from covarium.operators import sectors
from covarium.sources import readers


@pytest.mark.parametrize("bins", [4, 1_024])
def test_quantiles_equal_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.standard_normal(500),
        "ties": rng.integers(0, 3, 300).astype(float),
        "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 200), -(10.0 ** rng.integers(-300, 300, 50))]),
        "near": 1 + np.arange(40) * np.finfo(float).eps,
        "one": np.array([7.5]),
        "edge": np.array([-1.7e308, 1.7e308, 0.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles.quantiles(df, "v", shares, "g").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        if g != "edge":
            assert np.allclose(got[g]["q"], np.quantile(values, shares), rtol=1e-12, atol=0)
    assert got["edge"]["q"][3] == 0.0
    assert quantiles.quantiles(df.limit(0), "v", shares).collect() == []
    assert quantiles.quantiles(df.where("g = 'ties'"), "v", [0.5]).first()["q"] == [float(np.median(groups["ties"]))]


def test_rank_correlations(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 6, 400), rng.standard_normal(400), rng.integers(0, 200, 400)], axis=1).astype(float)
    x[:, 2] += 40 * x[:, 0]

    def rank(v):
        return np.array([(v < y).sum() + ((v == y).sum() + 1) / 2 for y in v])

    want = np.corrcoef(np.stack([rank(c) for c in x.T]))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0)], "a double, b double, c double").repartition(5)
    got = {(r["a"], r["b"]): r["r"] for r in sectors.spearman(df, ["a", "b", "c"]).collect()}
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            assert got[p, q] == pytest.approx(want[i, j], abs=1e-12)


def test_contacts_by_cells(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-20, 20, (150, 3))
    x[0] = x[1] + [3.0, 4.0, 0.0]  # at the limit, not below it
    atoms = spark.createDataFrame([(k // 3, *map(float, v)) for k, v in enumerate(x)], "idx int, x double, y double, z double")
    residues = spark.range(50).select(F.col("id").cast("int").alias("idx"), F.col("id").cast("string").alias("label"))
    whole = {(r["a"], r["b"]): r["d"] for r in readers.residue_distances(residues, atoms).collect()}
    near = {(r["a"], r["b"]): r["d"] for r in readers.residue_distances(residues, atoms, 5.0).collect()}
    assert len(whole) == 2500 and near == {k: d for k, d in whole.items() if d < 5.0} and len(near) > 60


def test_distances_shuffle_atoms_not_pairs(spark, monkeypatch):
    """A grid of blocks: residues of one to four atoms in several cells, each compared with all others once."""
    monkeypatch.setattr(readers, "RESIDUES_A_BLOCK", 7)
    monkeypatch.setattr(readers, "DISTANCES", 50)
    rng = np.random.default_rng(5)
    of = np.sort(np.concatenate([np.arange(40), rng.integers(0, 40, 60)]))
    x = rng.uniform(-20, 20, (100, 3))
    atoms = spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(of, x, strict=True)], "idx int, x double, y double, z double")
    residues = spark.range(40).select(F.col("id").cast("int").alias("idx"), F.concat("id", F.lit("A")).alias("label"))
    found = readers.residue_distances(residues, atoms)
    got = [tuple(r) for r in found.collect()]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(f"{i}A", f"{j}A"): d[of == i][:, of == j].min() for i in range(40) for j in range(40)}
    assert len(got) == 1600 and {(a, b): v for a, b, v in got} == pytest.approx(want, abs=1e-12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # pairs of atoms are no rows of a table
