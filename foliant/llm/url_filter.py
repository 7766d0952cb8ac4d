"""URL verdicts: listed host and path rules first, else a tree of path templates per host.

A path is followed segment by segment, as long as a node has enough URLs for another branch. At each node of a host's tree a
segment value with enough URLs stays a literal branch, and every other value becomes the wildcard ``#*``; below a node with too few
URLs all that follows is one ``#*``. Then branches that differ at one place only and whose labelled shares of bad pages do not differ
by more than chance (a Hoeffding bound) are merged. What they are merged into is the wildcard of that place, unless the
place has a wildcard that is not like them: then they are a family of their own, ``#+``. A template is rejected when its share of good
labelled pages, smoothed towards the share over all pages, is below a threshold. (No segment of a path holds a ``#``.)

A host of any size is safe: counts are made per host, prefix and segment with map-side sums, only branches that
stay literal go back to the rows, and each level is written to the shared folder.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import keep

WILD, FAMILY = "#*", "#+"
ADDRESS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlRules:
    """``rules``: (verdict, host/path). A rule holds for its host and all hosts below it if the path starts with its path."""

    rules: tuple[tuple[str, str], ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    #: A literal branch has at least so many URLs.
    min_urls: int = 20
    #: Strength of the prior and least share of good pages, in hundredths.
    prior: int = 10
    min_good_percent: int = 50
    #: Chance with which the Hoeffding test may part equal branches.
    alpha: float = 0.05


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 2)


def rule_of(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that holds, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, spec: UrlRules = UrlRules(), id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad") -> DataFrame:
    """A verdict for every row: ``page_id, host, path, rule, verdict, template``.

    ``bad_col`` is 1 for a page that is known to be bad, 0 for one known to be good and null for all others. A URL
    that is null or has no ``://`` has an empty host and path and is judged like the others; rows that are there twice
    are judged twice; an empty table gives an empty result. Columns besides the three are not looked at.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(bad_col).cast("int").alias("bad"))
    rows = rows.withColumns({"segs": F.filter(F.split("path", "/"), lambda x: x != ""), "tpl": F.array().cast("array<string>")})
    rows, levels = _follow(keep(rows, "urls-0"), spec)
    verdicts = keep(_templates(rows, levels, spec), "templates")
    name, verdict = rule_of(spec.rules, F.col("host"), F.col("path"))
    judged = rows.join(verdicts, ["host", "tpl"])
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"),
                         F.array_join(F.transform("template", lambda x: F.when(x.isin(WILD, FAMILY), F.substring(x, 2, 1)).otherwise(x)), "/").alias("template"))


def _follow(rows: DataFrame, spec: UrlRules) -> tuple[DataFrame, int]:
    """Rows with their first template, and how long templates are at most. Rows leave the loop where their path ends, or
    where their node has too few URLs for a branch; the loop ends when none is left."""
    done = [rows.where(F.size("segs") == 0).drop("segs")]
    rest, depth = rows.where(F.size("segs") > 0), 0
    while not rest.isEmpty():
        here = rest.withColumn("seg", F.get("segs", F.lit(depth)))
        counts = here.groupBy("host", "tpl", "seg").agg(F.count(F.lit(1)).alias("c"))
        literal = keep(counts.where(F.col("c") >= spec.min_urls).select("host", "tpl", "seg", F.lit(True).alias("stays")), f"literals-{depth}")
        # Only a node that has enough URLs can have a branch below, be it through its wildcard.
        nodes = here.groupBy("host", "tpl").agg(F.count(F.lit(1)).alias("n"))
        nodes = keep(nodes.where(F.col("n") >= spec.min_urls).select("host", "tpl", F.lit(True).alias("parts")), f"nodes-{depth}")
        grown = here.join(nodes, ["host", "tpl"], "left").join(literal, ["host", "tpl", "seg"], "left")
        symbol = F.when(F.col("stays"), F.col("seg")).otherwise(WILD)
        open_ = F.coalesce("parts", F.lit(False)) & (F.size("segs") > depth + 1)
        grown = keep(grown.select("page_id", "host", "path", "bad", "segs", F.concat("tpl", F.array(symbol)).alias("tpl"), open_.alias("open")), f"urls-{depth + 1}")
        done.append(grown.where(~F.col("open")).drop("segs", "open"))
        rest, depth = grown.where("open").drop("open"), depth + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, depth


def _templates(rows: DataFrame, levels: int, spec: UrlRules) -> DataFrame:
    """Per host and first template: the template it is merged into and whether that is rejected."""
    t = rows.groupBy("host", "tpl").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).withColumn("template", F.col("tpl"))
    bound = (math.log(2 / spec.alpha) / 2) ** 0.5
    for depth in range(levels):
        place = F.get("template", F.lit(depth))

        def with_place(symbol: str) -> Column:
            return F.concat(F.slice("template", 1, depth), F.array(F.lit(symbol)), F.slice(F.col("template"), depth + 2, 2**31 - 1))

        # What the branches have in common apart from this place, and of equal templates so far their sum.
        t = t.withColumn("open", F.when(place.isNull(), F.col("template")).otherwise(with_place(WILD)))
        same, family = Window.partitionBy("host", "template"), Window.partitionBy("host", "open")
        t = t.withColumn("tn", F.sum("n").over(same)).withColumn("tb", F.sum("b").over(same))
        t = t.withColumn("lead", F.max(F.struct("tn", "template", "tb")).over(family))
        apart = F.abs(F.col("tb") / F.col("tn") - F.col("lead.tb") / F.col("lead.tn"))
        alike = (F.col("tn") == 0) | (apart <= bound * (1 / F.sqrt("tn") + 1 / F.sqrt(F.col("lead.tn"))))
        t = t.withColumn("alike", F.coalesce(alike, F.lit(False)))
        several = F.size(F.collect_set(F.when(F.col("alike"), F.col("template"))).over(family)) > 1
        # A wildcard that is not like the family keeps its name to itself.
        taken = F.max((~F.col("alike") & (F.col("template") == F.col("open"))).cast("int")).over(family) == 1
        t = t.withColumns({"several": several, "taken": taken})
        merged = F.when(F.col("taken"), with_place(FAMILY)).otherwise(F.col("open"))
        t = t.withColumn("template", F.when(F.col("alike") & F.col("several"), merged).otherwise(F.col("template"))).drop(
            "open", "tn", "tb", "lead", "alike", "several", "taken")
    whole = rows.agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    good, seen = (whole["n"] - whole["b"], whole["n"]) if whole["n"] else (1, 1)
    same = Window.partitionBy("host", "template")
    n, b = F.sum("n").over(same), F.sum("b").over(same)
    # (good here + prior * good / seen) / (n + prior) below the least share, in whole numbers.
    smoothed = ((n - b) * seen + spec.prior * good).cast("decimal(38,0)") * 100
    return t.withColumn("reject", smoothed < ((n + spec.prior) * seen).cast("decimal(38,0)") * spec.min_good_percent).select("host", "tpl", "template", "reject")

