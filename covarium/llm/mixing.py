"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

A token budget is handed down a tree (domain, language, source). A node's children get shares in
proportion to their weights; a child that can't supply its share gives what it lacks to its
siblings first, and only what all of them together can't supply goes up to the parent's siblings.
That is water-filling from the root with the subtrees' supplies as capacities: child c of a node
with budget B is full iff sum(capacities of fuller children) + ratio_c * sum(other weights) <= B,
where children are ordered by ratio = capacity / weight. Sums of integers make it exact.

Each leaf then takes whole epochs of its documents and, of one more epoch in a seeded order, the
longest prefix within the rest of its tokens. The order's leading bits are pre-aggregated per leaf,
so that a cut needs only the documents of one of ``SLICES`` slices sorted, whatever the leaf's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covarium.llm.shared import cut

LEVELS = ("domain", "lang", "source")
SLICES = 4096
BROADCAST_LEAVES = 20_000

#: The production weights of domains and languages; others have weight 1.
DOMAIN_WEIGHTS = {"d0": 5, "d1": 3, "d2": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 3}

_BIG = "decimal(38,0)"


def tokens_of(text: Column) -> Column:
    """Tokens of a text: words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def seeded(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def _spread(children: DataFrame, parent: list[str]) -> DataFrame:
    """Water-fill: children(parent..., weight, capacity, total) get ``budget``; total is the parent's."""
    ratio = F.col("capacity") / F.col("weight")
    key = [F.col(c) for c in parent]
    order = Window.partitionBy(*key).orderBy(ratio, *[c for c in LEVELS if c in children.columns])
    after = order.rowsBetween(1, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    rest = F.coalesce(F.sum("weight").over(after), F.lit(0)).cast(_BIG)
    filled = F.sum("capacity").over(upto).cast(_BIG)
    full = filled * F.col("weight") + F.col("capacity").cast(_BIG) * rest <= F.col("total").cast(_BIG) * F.col("weight")
    marked = children.withColumn("full", full)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    share = F.expr("cast(cast(total - spent as decimal(38,0)) * weight div open_weight as bigint)")
    return (
        marked.withColumn("spent", spent)
        .withColumn("open_weight", open_weight)
        .withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share))
        .drop("spent", "open_weight", "full")
    )


def plan_leaves(leaves: DataFrame, budget: int | Column, max_epochs: int) -> DataFrame:
    """``leaves(domain, lang, source, supply, w_domain, w_lang, w_source)`` with ``budget`` tokens for each.

    Weights are positive integers. ``supply`` is one epoch; a leaf can give ``max_epochs`` of them.
    A budget above all capacities fills every leaf.
    """
    leaves = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("all"))
    amount = budget if isinstance(budget, Column) else F.lit(budget)
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("w_domain").alias("weight")).crossJoin(F.broadcast(total)).withColumn("total", amount.cast("long"))
    domains = _spread(domains, []).select("domain", F.col("budget").alias("total"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("w_lang").alias("weight")).join(domains, "domain")
    langs = _spread(langs, ["domain"]).select("domain", "lang", F.col("budget").alias("total"))
    own = leaves.withColumn("weight", F.col("w_source")).join(langs, ["domain", "lang"])
    return _spread(own, ["domain", "lang"]).select(*LEVELS, "supply", "budget")


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, Column],
    budget: Column,
    max_epochs: int = 2,
    seed: str = "mix-1",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row for each chosen (document, epoch): ``keep`` columns, the levels, ``tokens`` and ``epoch`` (from 0).

    ``levels`` gives domain, lang and source from the columns of ``docs(doc_id, text, ...)``, ``weights``
    integer weights from those three; ``budget`` is in tokens and may use ``all``, the corpus's
    tokens. Null level values count as ''. Documents without tokens (null, empty or white texts)
    are in no epoch. Documents that tie in the seeded order (repeated doc_id) are cut together: a prefix takes
    none of a tie that would pass the budget. An empty table gives an empty one.
    """
    named = {f"_{k}": F.coalesce(levels[k].cast("string"), F.lit("")) for k in LEVELS}
    key = [f"_{k}" for k in LEVELS]
    slim = [F.col("doc_id").alias("_id"), tokens_of(F.col("text")).alias("_tokens"), *[c.alias(k) for k, c in named.items()]]
    counted = cut(docs.select(*slim).where("_tokens > 0"))  # texts are read once for all counts
    if keep == ("doc_id",):
        rows = counted.withColumn("_kept", F.struct(F.col("_id").alias("doc_id")))
    else:
        rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_kept"), *slim).where("_tokens > 0")

    supply = cut(counted.groupBy(*key).agg(F.sum("_tokens").alias("supply")))
    leaves = supply.select(*[F.col(f"_{k}").alias(k) for k in LEVELS], "supply")
    leaves = leaves.select("*", *[weights[k].cast("long").alias(f"w_{k}") for k in LEVELS])
    plan = plan_leaves(leaves, budget, max_epochs)
    plan = plan.withColumn("epochs", F.expr("budget div supply")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    plan = cut(plan.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], "epochs", "rest"))
    few = plan.count() <= BROADCAST_LEAVES

    def with_plan(df: DataFrame, p: DataFrame) -> DataFrame:
        return df.join(F.broadcast(p) if few else p, key)

    # Tokens of each slice of the last epoch's order, and the slice in which a leaf's rest ends.
    order = seeded(seed, F.col("epochs"), F.col("_id"))
    slice_ = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    slices = with_plan(counted, plan).withColumn("slice", slice_).groupBy(*key, "slice").agg(F.sum("_tokens").alias("held"), F.first("rest").alias("rest"))
    running = F.sum("held").over(Window.partitionBy(*key).orderBy("slice"))
    ends = slices.withColumn("after", running).where("after > rest").groupBy(*key).agg(F.min(F.struct("slice", F.expr("after - held").alias("before"))).alias("cut"))
    plan = cut(plan.join(ends, key, "left").select(*key, "epochs", "rest", F.coalesce("cut.slice", F.lit(SLICES)).alias("at"), "cut.before"))

    placed = with_plan(rows, plan).withColumn("_order", order).withColumn("_slice", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    base = [F.col("_kept"), *[F.col(k) for k in key], F.col("_tokens")]
    copies = F.when(F.col("_slice") < F.col("at"), F.col("epochs") + 1).otherwise(F.col("epochs")).cast("int")
    whole = placed.select(*base, F.posexplode(F.array_repeat(F.lit(0), copies)).alias("epoch", "_zero")).select(*base, F.col("epoch").cast("long").alias("epoch"))
    prefix = F.sum("_tokens").over(Window.partitionBy(*key).orderBy("_order"))
    edge = placed.where(F.col("_slice") == F.col("at")).withColumn("_sum", F.col("before") + prefix).where(F.col("_sum") <= F.col("rest")).select(*base, F.col("epochs").alias("epoch"))
    return whole.union(edge).select("_kept.*", *[F.col(f"_{k}").alias(f"mix_{k}") for k in LEVELS], F.col("_tokens").alias("tokens"), "epoch")


def weight_of(column: str, table: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, weight in table.items():
        out = F.when(F.col(column) == value, weight).otherwise(out)
    return out


def production(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The mix with production parameters: half of all tokens, at most two epochs."""
    domain = F.concat(F.lit("d"), F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)") % 3, F.lit(0)).cast("string"))
    return mix(
        docs,
        {"domain": domain, "lang": F.col("lang"), "source": F.col("source")},
        {"domain": weight_of("domain", DOMAIN_WEIGHTS), "lang": weight_of("lang", LANG_WEIGHTS), "source": F.lit(1)},
        F.floor(F.col("all") / 2),
        keep=keep,
    )


def _level_sql(children: str, parent: str, key: str, weight: str, out: str) -> str:
    """One level of the water-filling in SQL; ``children`` has capacity, ``parent`` total."""
    over = f"PARTITION BY {key}" if key else ""
    names = ", ".join(x for x in ("domain", "lang", "source") if x in out.split(","))
    return f"""
  SELECT {out}, CASE WHEN is_full THEN capacity ELSE CAST((total - spent) * {weight} // open_weight AS BIGINT) END AS total
  FROM (SELECT *, coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({over}), 0) AS spent, sum(CASE WHEN NOT is_full THEN {weight} END) OVER ({over}) AS open_weight
  FROM (SELECT *, sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * {weight}
      + capacity * coalesce(sum({weight}) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) <= total * {weight} AS is_full
    FROM (SELECT c.*, p.total FROM {children} c JOIN {parent} p {f"USING ({key})" if key else "ON true"})
    WINDOW o AS ({over} ORDER BY capacity / {weight}, {names})))"""


def _case(column: str, table: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END"


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, 'd' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3, 0) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS tokens
  FROM documents
), rows_ AS (SELECT * FROM docs WHERE tokens > 0),
leaves AS (
  SELECT domain, lang, source, sum(tokens) AS supply, 2 * sum(tokens) AS capacity, {_case("domain", DOMAIN_WEIGHTS)} AS w_domain, {_case("lang", LANG_WEIGHTS)} AS w_lang, 1 AS w_source
  FROM rows_ GROUP BY domain, lang, source
), everything AS (SELECT sum(supply) // 2 AS total FROM leaves),
c1 AS (SELECT domain, sum(capacity) AS capacity, max(w_domain) AS w_domain FROM leaves GROUP BY domain),
t1 AS ({_level_sql("c1", "everything", "", "w_domain", "domain")}),
c2 AS (SELECT domain, lang, sum(capacity) AS capacity, max(w_lang) AS w_lang FROM leaves GROUP BY domain, lang),
t2 AS ({_level_sql("c2", "t1", "domain", "w_lang", "domain,lang")}),
t3 AS ({_level_sql("leaves", "t2", "domain, lang", "w_source", "domain,lang,source,supply")}),
plan AS (SELECT *, total // supply AS epochs, total - total // supply * supply AS rest FROM t3),
ordered AS (
  SELECT r.*, p.epochs, p.rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix-1:' || CAST(p.epochs AS BIGINT) || ':' || doc_id)) AS upto
  FROM rows_ r JOIN plan p USING (domain, lang, source)
)
SELECT doc_id, domain AS mix_domain, lang AS mix_lang, source AS mix_source, tokens, CAST(epoch AS BIGINT) AS epoch
FROM (SELECT *, unnest(range(CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM ordered)
"""
