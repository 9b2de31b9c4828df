"""Letters, numbers and headers of an alignment.

An alignment is a DataFrame ``msa(seq_id LONG, hd STRING, seq STRING)``. Letters count from 1 in
the order of ``ALPHABET``; everything else is 0, a gap. ``cells(seq_id, pos, code)`` is the long form
(positions from 0), and, without its gaps, the sparse one-hot matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The letters in their order, and how often each occurs in natural sequences.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
GAP = "-"
BACKGROUND = (0.073, 0.025, 0.050, 0.061, 0.042, 0.072, 0.023, 0.053, 0.064, 0.089, 0.023, 0.043, 0.052, 0.040, 0.052, 0.073, 0.056, 0.063, 0.013, 0.033)

LETTERS = len(ALPHABET)


def clean(seq: Column, alphabet: str = ALPHABET, gap: str = GAP) -> Column:
    """Every character outside the alphabet (lower case too) becomes a gap."""
    return F.regexp_replace(seq, f"[^{alphabet}]", gap)


def tidy(seq: Column) -> Column:
    """Without white space, dots as gaps."""
    return F.translate(seq, ". \t\r\n", "-")


def is_standard(seq: Column) -> Column:
    return F.upper(seq).rlike(f"^[{ALPHABET}-]*$")


def ungapped(seq: Column) -> Column:
    return F.translate(seq, "-.", "")


def codes(seq: Column) -> Column:
    """Letters as numbers 1 to 20, in either case; others 0."""
    return F.transform(F.split(seq, ""), lambda c: F.instr(F.lit(ALPHABET), F.upper(c)) * (c != "").cast("int"))


def gap_fraction(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(GAP), F.lit("")))) / F.length(seq)


def identity(a: Column, b: Column) -> Column:
    """Share of all columns in which two aligned sequences agree, gaps with gaps included."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.length(a)


def cells(msa: DataFrame, gaps: bool = False) -> DataFrame:
    """(seq_id, pos, code), with or without the gaps; other columns of ``msa`` but hd and seq stay."""
    rest = [c for c in msa.columns if c not in ("seq_id", "hd", "seq")]
    out = msa.select("seq_id", *rest, F.posexplode(codes(F.col("seq"))).alias("pos", "code"))
    return out if gaps else out.where("code > 0")


def one_hot_columns(msa: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(seq_id, col) of the ones of the binary alignment, col = pos * letters + code - 1."""
    return cells(msa).where(F.col("code") <= letters).select("seq_id", (F.col("pos") * letters + F.col("code") - 1).alias("col"))


def pick(seq: Column, positions: list[int]) -> Column:
    """The letters at the given positions (from 0): column pruning of an alignment."""
    return F.concat(*[F.substring(seq, p + 1, 1) for p in positions]) if positions else F.lit("")


# --- headers ----------------------------------------------------------------------------------------


def header_fields(hd: Column, delim: str = "|") -> Column:
    """Fields of a header; a delimiter inside braces does not split.

    The n-th field with an opening brace is joined with all up to the n-th one with a closing brace; braces without a
    partner stay as they are, and a closing one before its opening one leaves an empty field there.
    """
    fields = F.split(hd, "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in delim))
    places = lambda f, brace: F.filter(F.sequence(F.lit(1), F.size(f)), lambda i: F.contains(F.element_at(f, i), F.lit(brace)))
    pairs = F.filter(F.zip_with(places(fields, "{"), places(fields, "}"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    start = F.struct(fields.alias("f"), F.lit(0).alias("gone"))

    def join(s, p):
        a, b = p["a"] - s["gone"], p["b"] - s["gone"]
        size = F.size(s["f"])
        middle = F.array_join(F.slice(s["f"], a, F.greatest(b - a + 1, F.lit(0))), delim)
        rest = F.slice(s["f"], F.least(F.greatest(b + 1, a), size + 1), F.greatest(size - F.greatest(b, a - 1), F.lit(0)))
        return F.struct(F.concat(F.slice(s["f"], F.lit(1), a - 1), F.array(middle), rest).alias("f"), (s["gone"] + p["b"] - p["a"]).alias("gone"))

    return F.aggregate(pairs, start, join, lambda s: s["f"])


def first_token(hd: Column) -> Column:
    return F.split(F.trim(hd), r"\s+")[0]


def family_id(hd: Column) -> Column:
    """What stands before the first slash."""
    return F.substring_index(hd, "/", 1)


def taxonomy(text: Column) -> Column:
    """A lineage ``a; b; c`` as ``a,b,c``."""
    return F.array_join(F.transform(F.split(text, ";"), lambda x: F.trim(x)), ",")


def change_delimiter(msa: DataFrame, old: str, new: str) -> DataFrame:
    """Headers with another delimiter; raises if a header has the new one in a field."""
    if msa.where(F.contains(F.col("hd"), F.lit(new))).limit(1).count():
        raise ValueError(f"a header already contains {new!r}")
    return msa.withColumn("hd", F.replace("hd", F.lit(old), F.lit(new)))


def field_count_mode(msa: DataFrame, delim: str) -> DataFrame:
    """The usual number of header fields, and how many headers have another."""
    n = msa.select(F.size(F.split("hd", "\\" + delim if len(delim) == 1 and not delim.isalnum() else delim)).alias("n"))
    usual = n.agg(F.mode("n", True).alias("usual"))
    return n.crossJoin(F.broadcast(usual)).groupBy("usual").agg(F.sum((F.col("n") != F.col("usual")).cast("int")).alias("others"))


def accession(msa: DataFrame, tag: str, delim: str = "|") -> DataFrame:
    """(seq_id, acc): the field after ``tag``, at the place where the first header has it."""
    first = msa.orderBy("seq_id").select(F.split("hd", f"[{delim}]").alias("f")).first()
    if first is None or tag not in first["f"]:
        raise ValueError(f"the first header has no field {tag!r}")
    return msa.select("seq_id", F.get(F.split("hd", f"[{delim}]"), F.lit(first["f"].index(tag) + 1)).alias("acc"))


def safe_name(name: str) -> str:
    """A name that MATLAB accepts for a struct: letters, digits and underscores, a letter first."""
    import re

    name = re.sub(r"\W", "_", name, flags=re.ASCII)
    return name if name[:1].isalpha() else "x" + name
