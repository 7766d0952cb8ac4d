"""Mixing sources to target weights by hierarchical budgets.

The sources form a tree: domain, language, source (or other columns). A token budget is handed down from
the root. Each node splits its budget among its children by their weights; a child that cannot use its
share (its tokens times the number of epochs that are allowed) takes what it can, and its siblings share
what it leaves by their weights. As a node never gets more than its children can use together, a shortage
leaves a family only if the whole family is full. Each leaf then takes whole epochs, and of one more epoch
the prefix, in an order seeded by the epoch, that still fits its budget.

All rows are read once to count the tokens of each leaf. The tree itself has a row per source. The
prefix of a leaf of any size comes from sums per bucket of the seeded order, so no leaf is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import keep, n_words

#: The seeded order is split by its first three hex digits.
BUCKET_DIGITS = 3
WHOLE = "decimal(38,0)"


@dataclass(frozen=True)
class MixSpec:
    """``weights``: per level, whole weights by value; a value that is not listed has the weight 1, weight 0 takes it out.

    ``budget``: tokens to hand out; None: as many as there are.
    """

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    max_epochs: int = 3
    seed: int = 42
    budget: int | None = None


def _weight(spec: MixSpec, level: str) -> Column:
    listed = spec.weights.get(level, {})
    out = F.lit(1)
    for value, w in sorted(listed.items()):
        out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
    return out.cast("long")


def leaf_budgets(leaves: DataFrame, spec: MixSpec) -> DataFrame:
    """The budget of each leaf: ``leaves`` has the level columns and ``n_tokens``; adds ``budget``.

    Whole numbers throughout, rounded down, so a family can fall short by less than a token per child.
    """
    tree = leaves.withColumn("cap", F.col("n_tokens").cast(WHOLE) * spec.max_epochs)
    for level in spec.levels:
        tree = tree.withColumn(f"__w_{level}", _weight(spec, level))
    tree = tree.where(" and ".join(f"__w_{x} > 0" for x in spec.levels))
    total = tree.agg(F.sum("n_tokens")).first()[0] or 0
    budget = total if spec.budget is None else spec.budget
    given = None
    for depth, level in enumerate(spec.levels):
        parents, path = list(spec.levels[:depth]), list(spec.levels[: depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("cap").cast(WHOLE).alias("cap"), F.first(f"__w_{level}").alias("w"))
        if given is None:
            cap_all = F.sum("cap").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("b", F.least(F.lit(budget).cast(WHOLE), cap_all.cast(WHOLE)))
        else:
            nodes = nodes.join(given.withColumnRenamed("budget", "b"), parents)
        given = _split(nodes, parents, level).select(*path, "budget")
    return leaves.join(given, list(spec.levels), "left").withColumn("budget", F.coalesce(F.col("budget"), F.lit(0)).cast("long"))


def _split(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Split the budget ``b`` of each family by ``w`` under the ceilings ``cap``.

    Children are ordered by ceiling per weight. One is full if its ceiling is at most its share of what the
    fuller ones before it leave; from the first that is not full on, the rest is shared by weight.
    """
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = family.orderBy(F.col("cap").cast("double") / F.col("w"), level)
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(WHOLE)
    rest = F.sum("w").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    x = nodes.withColumn("before", before).withColumn("rest", rest)
    x = x.withColumn("full", F.col("cap") * F.col("rest") <= F.col("w") * (F.col("b") - F.col("before")))
    some = ~F.col("full")
    x = x.withColumn("left", F.col("b") - F.min(F.when(some, F.col("before"))).over(family))
    x = x.withColumn("among", F.max(F.when(some, F.col("rest"))).over(family))
    share = F.expr("cast(w * `left` as decimal(38,0)) div among")
    return x.withColumn("budget", F.when(F.col("full"), F.col("cap").cast("long")).otherwise(share).cast("long"))


def mix(docs: DataFrame, spec: MixSpec, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The documents of each epoch, a row per document and epoch.

    Columns: the id as ``doc_id``, the levels, ``n_tokens`` (words, unless ``tokens`` says otherwise) and ``epoch`` from 1. A null
    level counts as the empty value; a null text has no tokens and stays in whole epochs, and in a prefix where its
    place falls inside. A null id has the place of the text "null". Rows that are there twice are taken as two; an empty table gives
    an empty result. Other columns are not looked at.
    """
    keys = [f"__l_{x}" for x in spec.levels]
    out = _mixed(docs, spec, id_col, text_col, tokens, [])
    return out.select(F.col("__id").alias("doc_id"), *[F.col(k).alias(x) for k, x in zip(keys, spec.levels)], F.col("__n").alias("n_tokens"), "epoch")


def mix_documents(docs: DataFrame, spec: MixSpec, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The same rows as ``mix``, with all columns of the documents as they were and nothing else: a document of two epochs is there twice."""
    out = _mixed(docs, spec, id_col, text_col, tokens, docs.columns)
    return out.select(*[F.col(f"__c_{c}").alias(c) for c in docs.columns])


def _mixed(docs: DataFrame, spec: MixSpec, id_col: str, text_col: str, tokens: Column | None, carry: list[str]) -> DataFrame:
    levels = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(f"__l_{x}") for x in spec.levels]
    keys = [f"__l_{x}" for x in spec.levels]
    count = n_words(F.col(text_col)) if tokens is None else tokens
    # Counted once; without columns to carry the rows are small from here on.
    rows = keep(docs.select(F.col(id_col).alias("__id"), count.alias("__n"), *levels, *[F.col(c).alias(f"__c_{c}") for c in carry]), "counted")
    leaves = keep(rows.groupBy(*keys).agg(F.sum("__n").alias("n_tokens")), "leaves")
    leaves = leaves.select(*[F.col(k).alias(x) for k, x in zip(keys, spec.levels)], "n_tokens")
    plan = leaf_budgets(leaves, spec).where("budget > 0")
    plan = plan.select(*[F.col(x).alias(k) for k, x in zip(keys, spec.levels)], F.expr("budget div n_tokens").alias("__whole"),
                       F.expr("budget % n_tokens").alias("__rest"))
    # The budgets are written, so that their size is known and a join can be planned by it.
    placed = rows.join(keep(plan, "budgets"), keys)
    whole = placed.where("__whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("__whole").cast("int")))).drop("__whole", "__rest")
    return whole.unionByName(_prefix(placed.where("__rest > 0"), keys, spec.seed))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _prefix(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Of the epoch after the whole ones, the rows whose tokens end within ``__rest``."""
    epoch = (F.col("__whole") + 1).cast("int")
    rows = rows.withColumn("epoch", epoch).withColumn("__key", order_key(seed, F.col("epoch"), F.col("__id")))
    rows = rows.withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    sums = rows.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__key", "__n").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("__end", F.sum("__n").over(inside)).join(starts, [*keys, "__bucket"])
    fits = ends.where(F.col("__start") + F.col("__end") <= F.col("__rest"))
    return fits.drop("__key", "__bucket", "__end", "__start", "__whole", "__rest")
