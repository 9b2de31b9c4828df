"""The tables behind the usual plots; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covarium.functions.quantiles import quantiles


def spectrum_histogram(values: DataFrame, bins: int, column: str = "eigval") -> DataFrame:
    """(bin, n) over equal bins between the extremes."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return values.crossJoin(F.broadcast(ends)).select(F.when(F.col("hi") > F.col("lo"), F.least(at, F.lit(bins - 1))).otherwise(0).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def matrix_summary(matrix: DataFrame, column: str = "c") -> DataFrame:
    """Least, greatest, mean and standard deviation without NaN."""
    rows = matrix.where(~F.isnan(column))
    return rows.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def palette_index(matrix: DataFrame, colours: int = 256, column: str = "c") -> DataFrame:
    """Colour number of each cell: floor of the normalised value times (colours - 1)."""
    ends = matrix.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return matrix.crossJoin(F.broadcast(ends)).withColumn("colour", F.floor(norm * (colours - 1)).cast("int")).drop("lo", "hi")


def weight_colours(weights: DataFrame) -> DataFrame:
    """(seq_id, colour): -ln(w) rescaled to [0, 1]; draw in its order."""
    value = -F.log("w")
    ends = weights.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return weights.crossJoin(F.broadcast(ends)).select("seq_id", F.when(F.col("hi") > F.col("lo"), (value - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("colour"))


def stacked_bars(member: DataFrame, length: int) -> DataFrame:
    """(pos, k, height): membership of each position in each group, as stacked bars show it."""
    spark = member.sparkSession
    return spark.range(length).select(F.col("id").cast("int").alias("pos")).join(member.select("pos", "k", F.lit(1).alias("height")), "pos", "left").withColumn("height", F.coalesce("height", F.lit(0)))


def component_scatter(modes: DataFrame, a: int, b: int, member: DataFrame | None = None) -> DataFrame:
    """(pos, x, y, k): two components against each other, with the group of each position (-1: none)."""
    x = modes.where(F.col("k") == a).select("pos", F.col("v").alias("x"))
    y = modes.where(F.col("k") == b).select("pos", F.col("v").alias("y"))
    out = x.join(y, "pos")
    if member is None:
        return out.withColumn("k", F.lit(-1))
    return out.join(member.groupBy("pos").agg(F.min("k").alias("k")), "pos", "left").withColumn("k", F.coalesce("k", F.lit(-1)))


def sequence_scatter(u: DataFrame, a: int, b: int, families: DataFrame | None = None) -> DataFrame:
    """(seq_id, x, y, family): sequences along two coordinates of (seq_id, k, u), with the family of each, null without one."""
    out = u.where(F.col("k").isin(a, b)).groupBy("seq_id").agg(F.max(F.when(F.col("k") == a, F.col("u"))).alias("x"), F.max(F.when(F.col("k") == b, F.col("u"))).alias("y"))
    return out.withColumn("family", F.lit(None).cast("string")) if families is None else out.join(families.select("seq_id", "family"), "seq_id", "left")


def mapping(positions: DataFrame, sequences: DataFrame, a: int, b: int, families: DataFrame | None = None) -> DataFrame:
    """(kind, id, x, y, family): positions along two modes (pos, k, v), and sequences along the coordinates that belong to them, for one picture."""
    own = component_scatter(positions, a, b).select(F.lit("position").alias("kind"), F.col("pos").cast("long").alias("id"), "x", "y", F.lit(None).cast("string").alias("family"))
    seqs = sequence_scatter(sequences, a, b, families).select(F.lit("sequence").alias("kind"), F.col("seq_id").cast("long").alias("id"), "x", "y", F.col("family").cast("string").alias("family"))
    return own.unionByName(seqs)


def coloured_units(member: DataFrame) -> DataFrame:
    """(pos, k, hue, strength): units of positions (k, pos, v) in evenly spaced hues, stronger for larger values within the unit."""
    n = member.agg(F.count_distinct("k").alias("n"))
    place = member.select("k").distinct().withColumn("place", F.row_number().over(Window.orderBy("k")) - 1)  # as many rows as units
    most = member.groupBy("k").agg(F.max("v").alias("most"))
    out = member.join(F.broadcast(place), "k").join(F.broadcast(most), "k").crossJoin(F.broadcast(n))
    return out.select("pos", "k", (F.col("place") / F.col("n")).alias("hue"), F.when(F.col("most") > 0, F.greatest(F.col("v") / F.col("most"), F.lit(0.0))).otherwise(0.0).alias("strength"))


def component_correlations(modes: DataFrame, n: int) -> DataFrame:
    """(a, b, r): rank correlations between the first n components (pos, k, v)."""
    from covarium.operators import sectors

    wide = modes.where(F.col("k") < n).groupBy("pos").pivot("k", list(range(n))).agg(F.first("v")).na.fill(0.0)
    return sectors.spearman(wide.toDF("pos", *[f"c{k}" for k in range(n)]).drop("pos"), [f"c{k}" for k in range(n)])


def quartile_width(values: DataFrame, column: str) -> DataFrame:
    """(n, q1, q3, width): histogram bin width 2 * (q3 - q1) * n ** -0.33."""
    q = quantiles(values, column, [0.25, 0.75]).select("n", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    return q.withColumn("width", 2 * (F.col("q3") - F.col("q1")) * F.pow(F.col("n"), F.lit(-0.33)))


def leaf_order(similarity, most: int = 2_000) -> list[int]:
    """Complete-linkage order (city-block distances) of a similarity array of at most ``most`` rows, for heat maps."""
    import numpy as np

    x = np.asarray(similarity, float)
    if len(x) > most:
        raise ValueError(f"a heat map has at most {most} rows; sample the sequences first")
    d = np.abs(x[:, None, :] - x[None, :, :]).sum(axis=2) if len(x) <= 200 else np.array([np.abs(x - row).sum(axis=1) for row in x])
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(x))}
    while len(groups) > 1:
        i, j = divmod(int(d.argmin()), len(d))
        i, j = min(i, j), max(i, j)
        groups[i] += groups.pop(j)
        row = np.maximum(d[i], d[j])
        d[i] = d[:, i] = row
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
    return groups[min(groups)] if groups else []
