"""Annotations of sequences by joins with tables of descriptions and lineages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions import encode

UNKNOWN = "unknown"


def annotate(msa: DataFrame, table: DataFrame) -> DataFrame:
    """``msa`` with description, species and lineage of ``table(id, acc, description, species, taxonomy)``.

    The header's part before the slash is looked up as id, then as acc; what is in neither is ``unknown``.
    """
    key = encode.family_id(F.col("hd"))
    values = ["description", "species", "taxonomy"]
    by_id = table.where("id is not null").dropDuplicates(["id"]).select(F.col("id").alias("_key"), *[F.col(c).alias(f"_1{c}") for c in values])
    by_acc = table.where("acc is not null").dropDuplicates(["acc"]).select(F.col("acc").alias("_key"), *[F.col(c).alias(f"_2{c}") for c in values])
    out = msa.withColumn("_key", key).join(by_id, "_key", "left").join(by_acc, "_key", "left")
    picked = {c: F.coalesce(f"_1{c}", f"_2{c}", F.lit(UNKNOWN)) for c in values}
    picked["taxonomy"] = encode.taxonomy(picked["taxonomy"])
    return out.select(*msa.columns, *[v.alias(k) for k, v in picked.items()])


def annotated_header(row: DataFrame, delim: str = "|") -> DataFrame:
    return row.withColumn("hd", F.concat_ws(delim, "hd", "description", "species", "taxonomy"))


def by_taxon_id(msa: DataFrame, ids: DataFrame, lineages: DataFrame) -> DataFrame:
    """Lineages through ``ids(seq_id, taxon)`` (0 counts as the root, 1) and ``lineages(taxon, species, taxonomy)``."""
    ids = ids.select("seq_id", F.when(F.col("taxon") == 0, 1).otherwise(F.col("taxon")).alias("taxon"))
    out = msa.join(ids, "seq_id", "left").join(lineages, "taxon", "left").drop("taxon")
    return out.withColumn("species", F.coalesce("species", F.lit(UNKNOWN))).withColumn("taxonomy", F.coalesce("taxonomy", F.lit(UNKNOWN)))


def taxon_counts(rows: DataFrame, taxonomy: Column, level: int, least: int = 10) -> DataFrame:
    """(taxon, n) at one level (from 0) of comma-joined lineages, of those with at least ``least`` rows."""
    taxon = F.get(F.split(taxonomy, ","), F.lit(level))
    return rows.groupBy(taxon.alias("taxon")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def last_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last one."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def protease_header(hd: Column) -> dict[str, Column]:
    """Taxon group and specificity of headers ``a|id...__group|...|specificity|...``."""
    fields = F.split(hd, r"\|")
    group = F.get(F.split(F.get(fields, F.lit(1)), "__"), F.lit(1))
    return {"taxon_group": group, "specificity": F.get(fields, F.lit(3)), "vertebrate": F.contains(F.lower(hd), F.lit("vertebrat"))}


def replace_headers(msa: DataFrame, headers: DataFrame) -> DataFrame:
    """New headers by row number; raises unless there is one for every sequence."""
    if msa.count() != headers.count() or msa.join(headers, "seq_id", "left_anti").limit(1).count():
        raise ValueError("there must be one new header for each sequence")
    return msa.drop("hd").join(headers.select("seq_id", "hd"), "seq_id").select("seq_id", "hd", "seq")


def map_accessions(msa: DataFrame, ids: DataFrame, delim: str = "|") -> DataFrame:
    """Headers with their accession in front, from ``ids(old, new)``; the old id is the header's first field."""
    own = F.substring_index("hd", delim, 1)
    joiner = "___" if delim == "_" else delim
    return msa.withColumn("_old", own).join(ids.select(F.col("old").alias("_old"), "new"), "_old", "left").select("seq_id", F.concat_ws(joiner, F.coalesce("new", F.lit(UNKNOWN)), "hd").alias("hd"), "seq")
