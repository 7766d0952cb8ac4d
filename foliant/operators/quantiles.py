"""Exact order statistics per group without sorting a group in one task.

A mergeable sketch brackets each wanted rank, one aggregation counts what lies below the bracket and
how often each value inside it occurs, and only those few distinct values are ranked, in small bins.
Groups of any size therefore cost two reads of the values: one for the brackets, which may give other aggregates as well, and one
that counts. Brackets are a row per group; they are kept first, and enter the second read as literals, or broadcast
where the number of groups has been counted and is small, so rows are not moved to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialize

SKETCH_ACCURACY = 10_000
BRACKET = 0.002
#: A bracket is at least so many ranks wide on either side, whatever the number of values.
BRACKET_RANKS = 4
BINS = 4096
_WIDTHS = [BRACKET * 10**i for i in range(3)] + [1.0]
#: Groups whose brackets may be broadcast: a few numbers each.
BROADCAST_GROUPS = 10_000


@dataclass(frozen=True)
class Quantile:
    """Interpolated between the values at ranks ``low`` and ``low + 1`` with weight ``frac`` on the upper."""

    name: str
    p: float
    kind: str  # "median" or "exclusive"

    def low(self, n: Column) -> Column:
        if self.kind == "median":
            return F.floor((n + 1) / 2).cast("long")
        num = self.num()
        j = F.floor(F.lit(num) * (n + 1) / 20).cast("long")
        return F.when(n < 20, n).otherwise(F.greatest(F.least(j, n - 1), F.lit(1)))

    def high(self, n: Column) -> Column:
        if self.kind == "median":
            return F.floor(n / 2).cast("long") + 1
        return F.when(n < 20, n).otherwise(self.low(n) + 1)

    def value(self, n: Column, x_low: Column, x_high: Column) -> Column:
        if self.kind == "median":
            return (x_low + x_high) / 2
        up = F.lit(self.num()) * (n + 1) - 20 * self.low(n)
        return F.when(n < 20, x_low).otherwise((x_low * (20 - up) + x_high * up) / 20)

    def num(self) -> int:
        return round(self.p * 20)


def p50(name: str) -> Quantile:
    return Quantile(name, 0.5, "median")


def p95(name: str) -> Quantile:
    """The exclusive 95th percentile; the maximum where there are fewer than 20 values."""
    return Quantile(name, 0.95, "exclusive")


def attach(df: DataFrame, small: DataFrame, group_cols: list[str]) -> DataFrame:
    """Add the columns of a one-row-per-group frame; one row overall becomes a scalar subquery."""
    if group_cols:
        return df.join(small, group_cols, "left")
    names = small.columns
    one = small.select(F.struct(*names).alias("s")).scalar()
    out = df.withColumn("__one", one)
    return out.select(*df.columns, *[F.col(f"__one.{c}").alias(c) for c in names])


def exact_quantiles(df: DataFrame, value: str, quantiles: list[Quantile], group_cols: list[str] | None = None, brackets: DataFrame | None = None) -> DataFrame:
    """One row per group with the named quantiles of ``value``; NULL values are ignored.

    ``brackets`` are a kept frame with the group columns and the columns of :func:`bracket_aggs`, where the caller has one.
    """
    g = list(group_cols or [])
    x = df.select(*g, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    if brackets is None:
        brackets = materialize(x.groupBy(*g).agg(*bracket_aggs(F.col("__v"), quantiles)))
    bounds = _bounds(brackets, quantiles, g)
    q = range(len(quantiles))

    # The second read: how many values lie below each bracket, and how often each value inside one occurs.
    v = F.col("__v")
    inside = F.lit(False)
    for i in q:
        inside = inside | v.between(F.col(f"__lo{i}"), F.col(f"__hi{i}"))
    counted = materialize(
        _beside(x, bounds, g)
        .groupBy(*g, F.when(inside, v).alias("__k"))
        .agg(F.count(F.lit(1)).alias("__c"), *[F.count_if(v < F.col(f"__lo{i}")).alias(f"__b{i}") for i in q])
    )
    below = counted.groupBy(*g).agg(*[F.sum(f"__b{i}").alias(f"__below{i}") for i in q])
    head = bounds.join(below, g) if g else attach(bounds, below, g)

    # One row per group, target and distinct value of its bracket.
    targets = F.array(*[
        F.struct(F.lit(i).alias("t"), F.col(f"__lo{i}").alias("lo"), F.col(f"__hi{i}").alias("hi"),
                 F.col(f"__below{i}").alias("below"), quantiles[i].low(F.col("__n")).alias("r1"),
                 quantiles[i].high(F.col("__n")).alias("r2"))
        for i in q
    ])
    k = F.col("__k")
    cells = (
        attach(counted.where(k.isNotNull()).select(*g, "__k", "__c"), head.select(*g, targets.alias("__ts")), g)
        .select(*g, "__k", "__c", F.explode("__ts").alias("__t"))
        .select(*g, "__k", "__c", "__t.*")
        .where(k.between(F.col("lo"), F.col("hi")))
        .withColumn("__bin", F.when(F.col("hi") > F.col("lo"), F.least(
            F.lit(BINS - 1), F.floor((k - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))).otherwise(F.lit(0)).cast("int"))
    )
    per_target = Window.partitionBy(*g, "t").orderBy("__bin")
    bins = (
        cells.groupBy(*g, "t", "__bin").agg(F.sum("__c").alias("__m"), F.first("below").alias("below"),
                                            F.first("r1").alias("r1"), F.first("r2").alias("r2"))
        .withColumn("__start", F.col("below") + F.sum("__m").over(per_target) - F.col("__m"))
        .where((F.col("__start") < F.col("r2")) & (F.col("__start") + F.col("__m") >= F.col("r1")))
        .select(*g, "t", "__bin", "__start")
    )
    in_bin = Window.partitionBy(*g, "t", "__bin").orderBy("__k")
    ranked = (
        cells.join(bins, [*g, "t", "__bin"])
        .withColumn("__end", F.col("__start") + F.sum("__c").over(in_bin))
        .withColumn("__from", F.col("__end") - F.col("__c"))
    )

    def at(i, r):
        hit = (F.col("t") == i) & (F.col("__from") < F.col(r)) & (F.col(r) <= F.col("__end"))
        return F.max(F.when(hit, k))

    picked = ranked.groupBy(*g).agg(*[c for i in q for c in (at(i, "r1").alias(f"__x{i}"), at(i, "r2").alias(f"__y{i}"))])
    out = picked.join(bounds.select(*g, "__n"), g) if g else attach(picked, bounds.select("__n"), g)
    # A rank outside its bracket would leave a NULL: never expected, and never passed on in silence.
    missed = F.when(F.col("__n") > 0, F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
    return out.select(*g, *[
        F.coalesce(quantiles[i].value(F.col("__n"), F.col(f"__x{i}"), F.col(f"__y{i}")), missed).alias(quantiles[i].name) for i in q])


def bracket_aggs(v: Column, quantiles: list[Quantile]) -> list[Column]:
    """The aggregates that brackets are made of: the count and a sketch's values around each rank."""
    points = [p for z in quantiles for w in _WIDTHS for p in (max(z.p - w, 0.0), min(z.p + w, 1.0))]
    return [F.count(v).alias("__n"), F.percentile_approx(v, points, SKETCH_ACCURACY).alias("__p")]


def _bounds(b: DataFrame, quantiles: list[Quantile], g: list[str]) -> DataFrame:
    """Count and bracket per target; the sketch's rank error is far below the bracket's width.

    One rule for all sizes: the narrowest of a few widths that spans enough ranks.
    """
    step = F.lit(len(_WIDTHS) - 1)
    for j, w in reversed(list(enumerate(_WIDTHS[:-1]))):
        step = F.when(F.col("__n") * w >= BRACKET_RANKS, F.lit(j)).otherwise(step)
    b = b.withColumn("__step", step)
    cols = []
    for i in range(len(quantiles)):
        at = (F.col("__step") + i * len(_WIDTHS)) * 2
        cols += [F.get("__p", at).alias(f"__lo{i}"), F.get("__p", at + 1).alias(f"__hi{i}")]
    return b.select(*g, "__n", *cols)


def _beside(x: DataFrame, bounds: DataFrame, g: list[str]) -> DataFrame:
    """Rows with their group's brackets: literals, or a broadcast of a counted number of groups, or beyond it a join."""
    if not g:
        row = bounds.first()
        return x.select("*", *[F.lit(row[c]).cast("double").alias(c) for c in bounds.columns if c != "__n"])
    small = bounds.drop("__n")
    if bounds.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        small = F.broadcast(small)
    same = None
    for c in g:
        one = x[c].eqNullSafe(small[c])
        same = one if same is None else same & one
    return x.join(small, same, "left").select(*[x[c] for c in x.columns], *[small[c] for c in small.columns if c not in g])
