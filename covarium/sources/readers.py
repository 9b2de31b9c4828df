"""Readers. Text is read by Spark (plain or gzip), from any store that Spark reads."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covarium.functions.numbering import numbered, offsets
from covarium.functions.settle import settle


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of one file; ``line`` rises with the lines, with leaps. For files with an order among their lines."""
    return spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "\r$", "").alias("text"))


def detect_format(spark: SparkSession, path: str) -> str:
    """fasta, clustal or stockholm, by the first line that is not blank; fasta if unsure."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    text = (first[0] if first else "").strip()
    if text.upper().startswith("CLUSTAL"):
        return "clustal"
    return "stockholm" if text.startswith("#") and "STOCKHOLM" in text.upper() else "fasta"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, hd, seq): headers start with '>' at a line's start; sequence lines are joined and upper-cased.

    Records are split at line starts, so that a '>' inside a header stays; a file is divided at record ends, so that
    large files are read in parallel. seq_id counts the records of the path in the order of their files. A
    record without sequence raises when it is read.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r", "").alias("value"))
    rows = rows.withColumn("value", F.regexp_replace("value", "^\\s*>", "")).where("trim(value) <> ''")
    hd = F.trim(F.substring_index("value", "\n", 1))
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)")
    seq = F.upper(F.regexp_replace(body, r"\s", ""))
    checked = F.when(seq != "", seq).otherwise(F.raise_error(F.concat(F.lit("a record has no sequence: "), hd)))
    return _numbered(rows.select("_at", hd.alias("hd"), checked.alias("seq")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Row numbers from 0 in the order of ``_at``: counts for each partition of the scan, then an offset, no global sort."""
    own = Window.partitionBy("_part").orderBy("_at")
    return (
        rows.withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_own", F.row_number().over(own) - 1)
        .join(F.broadcast(offsets(rows, "_at")), "_part")
        .select((F.col("_before") + F.col("_own")).cast("long").alias("seq_id"), "hd", "seq")
    )


def _joined_blocks(lines: DataFrame) -> DataFrame:
    """(seq_id, hd, seq) from lines ``id fragment`` in blocks: fragments of an id joined, ids in first-seen order."""
    parts = lines.select("line", F.split(F.trim("text"), r"\s+").alias("p")).where(F.size("p") >= 2).select("line", F.col("p")[0].alias("hd"), F.col("p")[1].alias("frag"))
    by_id = parts.groupBy("hd").agg(F.min("line").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "frag"))), lambda x: x["frag"]), "").alias("seq"))
    seq = F.upper(F.translate("seq", ".", "-"))
    return numbered(by_id, "first", "seq_id").select("seq_id", "hd", seq.alias("seq"))


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """The first line that is not blank is the title; consensus lines are of '*', ':' and '.'."""
    lines = _lines(spark, path).where("trim(text) <> ''")
    title = lines.agg(F.min("line").alias("title"))
    rows = lines.crossJoin(F.broadcast(title)).where("line > title").where(~F.trim("text").rlike(r"^[*:.]"))
    return _joined_blocks(rows)


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """Lines from '#' on are markup; '//' ends the alignment."""
    lines = _lines(spark, path)
    end = lines.where("trim(text) = '//'").agg(F.min("line").alias("end"))
    rows = lines.crossJoin(F.broadcast(end)).where("end is null or line < end").where("trim(text) <> '' and not startswith(text, '#')")
    return _joined_blocks(rows)


def read_alignment(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    readers = {"fasta": read_fasta, "clustal": read_clustal, "stockholm": read_stockholm}
    return readers[format or detect_format(spark, path)](spark, path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(id, w) from ``id<TAB>weight``; lines that don't parse are skipped, the last of an id counts."""
    rows = _lines(spark, path).select("line", F.split("text", "\t").alias("p")).where(F.size("p") >= 2)
    rows = rows.select("line", F.trim(F.col("p")[0]).alias("id"), F.col("p")[1].try_cast("double").alias("w")).where("w is not null")
    return rows.groupBy("id").agg(F.max_by("w", "line").alias("w"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="rep string, member string")


def read_position_labels(spark: SparkSession, path: str) -> DataFrame:
    """(pos, label), one label a line."""
    rows = _lines(spark, path).where("trim(text) <> ''")
    return numbered(rows, "line", "pos").select(F.col("pos").cast("int").alias("pos"), F.trim("text").alias("label"))


def read_keep(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(i), from 0, of 1-based numbers parted by commas or spaces; '#' starts a comment; words are skipped, numbers outside 1 to n raise."""
    text = F.regexp_replace("text", "#.*", "")
    rows = _lines(spark, path).select(F.explode(F.split(text, r"[,\s]+")).alias("t")).select(F.col("t").try_cast("int").alias("k")).where("k is not null").distinct()
    bad = rows.where(~F.col("k").between(1, n)).limit(1).collect()
    if bad:
        raise ValueError(f"row {bad[0][0]} is not in the alignment of {n} rows")
    return rows.select((F.col("k") - 1).alias("i")).orderBy("i")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(id, acc, description, species, taxonomy) of a tab-separated table: the accession is field 0, the id field 1, then fields 5, 8 and 9 (from 0)."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    pick = {"acc": 0, "id": 1, "description": 5, "species": 8, "taxonomy": 9}
    return rows.select(*[F.get("p", F.lit(k)).alias(name) for name, k in pick.items()])


#: Three-letter names of the residues in the order of the one-letter alphabet.
RESIDUES = "ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR"


def residue_number(field: Column) -> Column:
    """The residue number, as text, of its four columns: a number, or from 10,000 on hybrid-36 (A000 to ZZZZ, then a000 to zzzz)."""
    first = F.substring(field, 1, 1)
    value = F.conv(F.upper(field), 36, 10).cast("long") + (10_000 - 10 * 36**3)
    return F.when(first.between("A", "Z"), value.cast("string")).when(first.between("a", "z"), (value + 26 * 36**3).cast("string")).otherwise(field)


def read_structure(spark: SparkSession, path: str, chain: str = "A") -> tuple[DataFrame, DataFrame]:
    """Residues (idx, label, aa) and atoms (idx, x, y, z) of one chain in the first model of a PDB file.

    Labels are residue number and insertion code; unknown residues are X.
    """
    lines = _lines(spark, path)
    end = lines.where("startswith(text, 'ENDMDL')").agg(F.min("line").alias("end"))
    atom = lines.crossJoin(F.broadcast(end)).where("(end is null or line < end) and startswith(text, 'ATOM')").where(F.substring("text", 22, 1) == chain)
    names = dict(zip(RESIDUES.split(), "ACDEFGHIKLMNPQRSTVWY", strict=True))
    letter = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    at = lambda a, n: F.trim(F.substring("text", a, n))
    rows = atom.select("line", F.concat(residue_number(at(23, 4)), at(27, 1)).alias("label"), F.coalesce(letter[at(18, 3)], F.lit("X")).alias("aa"), *[at(a, 8).cast("double").alias(c) for c, a in (("x", 31), ("y", 39), ("z", 47))])
    residues = rows.groupBy("label").agg(F.min("line").alias("first"), F.first("aa").alias("aa"))
    residues = numbered(residues, "first", "idx").select(F.col("idx").cast("int").alias("idx"), "label", "aa")
    return residues, rows.join(residues.select("label", "idx"), "label").select("idx", "x", "y", "z")


def residue_distances(residues: DataFrame, atoms: DataFrame, limit: float | None = None) -> DataFrame:
    """(a, b, d): the smallest distance between atoms of two residues, by labels; with a ``limit`` only those below it.

    With a limit, atoms are dealt to cells as wide as it, and each is compared with those of its own cell and the 26 around, so that the
    work grows with the contacts. Without, all pairs are compared, in a grid of blocks of residues: atoms are shuffled, pairs never.
    """
    if limit is None:
        return _all_distances(residues, atoms)
    p = atoms.select(F.col("idx").alias("i"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    q = atoms.select(F.col("idx").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    d = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) ** 2 for c in "xyz"), F.lit(0.0)))
    cell = lambda c: F.floor(F.col(c) / limit)
    around = F.explode(F.array(*[F.array(*[F.lit(k) for k in step]) for step in itertools.product((-1, 0, 1), repeat=3)]))
    p = p.select("*", around.alias("step")).select("i", "x1", "y1", "z1", *[(cell(f"{c}1") + F.col("step")[k]).alias(f"c{c}") for k, c in enumerate("xyz")])
    q = q.select("*", *[cell(f"{c}2").alias(f"c{c}") for c in "xyz"])
    near = p.join(q, ["cx", "cy", "cz"]).where((F.col("i") <= F.col("j")) & (d < limit))
    pairs = near.groupBy("i", "j").agg(F.min(d).alias("d"))
    pairs = pairs.union(pairs.where("i < j").select("j", "i", "d"))
    names = residues.select("idx", "label")
    return pairs.join(names.select(F.col("idx").alias("i"), F.col("label").alias("a")), "i").join(names.select(F.col("idx").alias("j"), F.col("label").alias("b")), "j").select("a", "b", "d")


#: Residues of a block, and distances of atoms that are held at once.
RESIDUES_A_BLOCK = 1_024
DISTANCES = 1 << 18


def _all_distances(residues: DataFrame, atoms: DataFrame) -> DataFrame:
    """(a, b, d) of all pairs of residues; a cell of the grid gives those of two blocks, both ways round."""
    rows = settle(atoms.join(residues.select("idx", "label"), "idx").select("idx", "label", *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    parts = 1 + (rows.agg(F.max("idx")).first()[0] or 0) // RESIDUES_A_BLOCK
    part = F.floor(F.col("idx") / RESIDUES_A_BLOCK).cast("int")
    cells = rows.withColumn("part", part).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other"))
    cell = (F.least("part", "other").cast("long") * parts + F.greatest("part", "other")).alias("cell")
    cells = cells.select(cell, (F.col("part") <= F.col("other")).alias("first"), (F.col("part") >= F.col("other")).alias("second"), "idx", "label", *"xyz")
    tasks = min(parts * (parts + 1) // 2, 1 << 14)
    return cells.repartition(tasks, "cell").groupBy("cell").applyInArrow(_distances_of_cell, "a string, b string, d double")


def _distances_of_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches)).sort_by("idx")
    first, second = t.filter(t.column("first")), t.filter(t.column("second"))
    at = lambda side: np.stack([side.column(c).to_numpy() for c in "xyz"], axis=1)
    edges = lambda side: np.flatnonzero(np.diff(side.column("idx").to_numpy(), prepend=-1))
    p, q, starts, others = at(first), at(second), edges(first), edges(second)
    names, other_names = first.column("label").take(starts).combine_chunks(), second.column("label").take(others).combine_chunks()
    diagonal = first.num_rows == t.num_rows and second.num_rows == t.num_rows
    ends = np.append(starts[1:], len(p))
    lo = 0
    while lo < len(starts) and len(others):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + max(1, DISTANCES // len(q)), "right")))
        x = p[starts[lo] : ends[hi - 1]]
        d = np.zeros((len(x), len(q)))
        for c in range(3):
            d += (x[:, c, None] - q[None, :, c]) ** 2
        d = np.sqrt(np.minimum.reduceat(np.minimum.reduceat(d, others, axis=1), starts[lo:hi] - starts[lo], axis=0)).ravel()
        a, b = pa.array(np.repeat(np.arange(lo, hi), len(others))), pa.array(np.tile(np.arange(len(others)), hi - lo))
        a, b = names.take(a), other_names.take(b)
        for pair in ((a, b),) if diagonal else ((a, b), (b, a)):
            yield pa.RecordBatch.from_arrays([*pair, pa.array(d)], ["a", "b", "d"])
        lo = hi


def read_results(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
