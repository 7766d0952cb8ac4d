"""Recognised tables, blocks and layout: array work inside the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config
from foliant.config import TableSpec
from foliant.functions import parse
from foliant.operators.extract import explode_rows


def match_table(tables: Column, spec: TableSpec) -> Column:
    """The first table with enough rows, NULL if none."""
    return F.get(F.filter(tables, lambda t: F.size(t["rows"]) >= spec.min_rows), F.lit(0))


def table_rows(table: Column, spec: TableSpec) -> Column:
    """The rows behind the header; a lone row is never taken for a header."""
    rows = table["rows"]
    if not spec.header_required:
        return rows
    return F.when(F.size(rows) > 1, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)


def process_table(docs: DataFrame, spec: TableSpec, keys: list[str], tables_col: str = "tables") -> DataFrame:
    """Long cells: (keys, table_name, row, column_name, value, raw_value, confidence) of the matching table."""
    first = 1 if spec.header_required else 0
    t = docs.select(*keys, match_table(F.col(tables_col), spec).alias("t")).where(F.col("t").isNotNull())
    start = F.when(F.size("t.rows") > 1, F.lit(first)).otherwise(F.lit(0))
    rows = t.select(*keys, start.alias("s"), F.posexplode(table_rows(F.col("t"), spec)).alias("i", "cells"))
    cell = [
        F.when(F.size("cells") > j, F.struct(
            F.lit(c.name).alias("column_name"), parse.cell_value(F.col("cells")[j], c.field_type).alias("value"),
            F.col("cells")[j].alias("raw_value"), F.lit(config.CONF_CELL).alias("confidence")))
        for j, c in enumerate(spec.columns)
    ]
    numbered = rows.select(*keys, F.lit(spec.name).alias("table_name"), (F.col("i") + F.col("s")).alias("row"), "cells")
    return explode_rows(numbered, [*keys, "table_name", "row"], F.filter(F.array(*cell), lambda c: c.isNotNull()))


def column_sum(tables: Column, spec: TableSpec, column: str) -> Column:
    """Exact sum of a money column of the matching table; unreadable and blank cells are skipped."""
    j = [c.name for c in spec.columns].index(column)
    t = match_table(tables, spec)
    amounts = F.transform(table_rows(t, spec), lambda r: F.when(F.size(r) > j, parse.to_amount(F.get(r, F.lit(j)))))
    zero = F.lit(0).cast("decimal(38,6)")
    return F.when(t.isNotNull(), F.aggregate(amounts, zero, lambda a, x: (a + F.coalesce(x, F.lit(0).cast("decimal(28,6)"))).cast("decimal(38,6)")))


def grid_from_cells(df: DataFrame, cells: str, out: str) -> DataFrame:
    """Sparse (row_index, column_index, content) cells to a dense grid of texts, '' where nothing is.

    Blank cells for the whole grid are laid under the given ones, all are sorted by place, and the
    first of each place is kept: n log n, and the last of repeated cells wins. Each step is a column, so
    that no lambda makes it again per cell.
    """
    at = lambda name: F.array_max(F.transform(cells, lambda c: c[name])) + 1
    df = df.withColumns({"__w": at("column_index"), "__h": at("row_index")})
    given = F.transform(cells, lambda c, i: F.struct(
        (c["row_index"] * F.col("__w") + c["column_index"]).cast("int").alias("k"), (-i - 1).alias("o"), F.coalesce(c["content"], F.lit("")).alias("v")))
    blank = F.transform(F.sequence(F.lit(0), F.col("__h") * F.col("__w") - 1), lambda k: F.struct(k.alias("k"), F.lit(1).alias("o"), F.lit("").alias("v")))
    df = df.withColumn("__laid", F.array_sort(F.concat(given, blank)))
    df = df.withColumn("__flat", F.transform(F.filter(F.transform("__laid", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: (
        y["i"] == 0) | (F.get("__laid", y["i"] - 1)["k"] != y["x"]["k"])), lambda y: y["x"]["v"]))
    lines = F.transform(F.sequence(F.lit(0), F.col("__h") - 1), lambda r: F.slice("__flat", r * F.col("__w") + 1, F.col("__w")))
    whole = F.size("__flat") == F.col("__h") * F.col("__w")  # always; it names the column twice, so that it stays one
    return df.withColumn(out, F.when(whole, lines)).drop("__w", "__h", "__laid", "__flat")


def polygon_to_bbox(points: Column) -> Column:
    """Points to x, y, width, height, confidence; zeros for fewer than four points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    zero = F.lit(0.0)
    ok = F.size(points) >= 4

    def at(c):
        return F.when(ok, c).otherwise(zero)

    return F.struct(at(F.array_min(xs)).alias("x"), at(F.array_min(ys)).alias("y"), at(F.array_max(xs) - F.array_min(xs)).alias("width"),
                    at(F.array_max(ys) - F.array_min(ys)).alias("height"), at(F.lit(1.0)).alias("confidence"))


def table_summaries(tables: Column) -> Column:
    return F.transform(tables, lambda t, i: F.struct(
        i.alias("table_index"), F.size(t["rows"]).alias("rows"), F.coalesce(F.size(F.get(t["rows"], F.lit(0))), F.lit(0)).alias("columns"),
        t["headers"].isNotNull().alias("has_headers"), t["confidence"].alias("confidence")))


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def handwritten_summary(blocks: Column) -> Column:
    hand = F.filter(blocks, lambda b: b["is_handwritten"])
    return F.when(F.size(hand) > 0, F.struct(
        F.size(hand).alias("blocks_detected"), _mean(F.transform(hand, lambda b: b["confidence"])).alias("average_confidence"),
        F.substring(F.get(hand, F.lit(0))["content"], 1, 100).alias("sample_text")))


def ocr_confidence_scores(blocks: Column, tables: Column, fields: Column) -> Column:
    """text: mean block confidence; tables: 1 if there are any; fields: mean field confidence."""
    def entry(name, v):
        return F.struct(F.lit(name).alias("key"), v.cast("double").alias("value"))

    entries = F.array(
        entry("text", _mean(F.transform(blocks, lambda b: b["confidence"]))),
        entry("tables", F.when(F.size(tables) > 0, F.lit(1.0))),
        entry("fields", _mean(F.filter(F.transform(fields, lambda f: f["confidence"]), lambda c: c.isNotNull()))))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def page_text_stats(words: DataFrame, keys: list[str], keep_above: int = 30) -> DataFrame:
    """Word table (text, conf) to a row per page: words, mean of positive confidences, boxes kept."""
    conf = F.col("conf")
    return words.groupBy(*keys).agg(
        F.count_if(~parse.is_blank(F.col("text"))).alias("word_count"),
        F.coalesce(F.avg(F.when(conf > 0, conf)), F.lit(0.0)).alias("confidence"),
        F.count_if(conf > keep_above).alias("kept_words"))


def kept_words(words: DataFrame, keep_above: int = 30) -> DataFrame:
    return words.where(F.col("conf") > keep_above)


def _percentile(sorted_values: Column, p: float) -> Column:
    """Linear interpolation between closest ranks of a sorted array."""
    pos = (F.size(sorted_values) - 1) * F.lit(p)
    lo = F.floor(pos).cast("int")
    a = F.get(sorted_values, lo)
    b = F.coalesce(F.get(sorted_values, lo + 1), a)
    return a + (b - a) * (pos - lo)


def _variance(values: Column) -> Column:
    """Of a column of arrays, in one pass: sums and squares of the distances from the first value."""
    first = F.get(values, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    n = F.size(values)
    add = lambda a, v: F.struct((a["s"] + (v - first)).alias("s"), (a["q"] + (v - first) * (v - first)).alias("q"))
    return F.when(n > 0, F.aggregate(values, zero, add, lambda a: F.greatest((a["q"] - a["s"] * a["s"] / n) / n, F.lit(0.0))))


def layout_from_blocks(docs: DataFrame, blocks_col: str = "text_blocks", width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Layout features of a page from its text blocks: density, alignment, font terciles, margins."""
    b = F.col(blocks_col)
    pick = lambda fn: F.transform(b, lambda x: fn(x["bbox"]))
    step = docs.withColumns({
        "__left": pick(lambda r: r["x"]), "__right": pick(lambda r: r["x"] + r["width"]), "__top": pick(lambda r: r["y"]),
        "__bottom": pick(lambda r: r["y"] + r["height"]), "__h": F.array_sort(pick(lambda r: r["height"])),
        "__middle": pick(lambda r: r["x"] + r["width"] / 2),
        "__area": F.aggregate(pick(lambda r: r["width"] * r["height"]), F.lit(0.0), lambda a, x: a + x), "__n": F.size(b)})
    step = step.withColumns({
        "__vl": _variance(F.col("__left")), "__vr": _variance(F.col("__right")),
        "__vc": _variance(F.col("__middle")),
        "__p33": _percentile(F.col("__h"), 0.33), "__p67": _percentile(F.col("__h"), 0.67)})
    tight = width * 0.01
    some = F.col("__n") > 0
    share = lambda fn: F.when(some, F.size(F.filter("__h", fn)) / F.col("__n")).otherwise(0.0)
    side = lambda c: F.when(some, c).otherwise(0.0)
    density = F.col("__area") / (width * height)
    out = step.withColumns({
        "page_width": F.lit(width), "page_height": F.lit(height), "aspect_ratio": F.lit(width / height),
        "text_density": density, "white_space_ratio": 1 - density, "text_block_count": F.col("__n"),
        "average_text_block_size": F.col("__area") / F.greatest(F.col("__n"), F.lit(1)),
        "text_alignment": F.when(~some, "unknown").when((F.col("__vl") < tight) & (F.col("__vr") < tight), "justified")
        .when(F.col("__vl") < tight, "left").when(F.col("__vr") < tight, "right").when(F.col("__vc") < tight, "center").otherwise("mixed"),
        "font_small": share(lambda h: h <= F.col("__p33")),
        "font_medium": share(lambda h: (h > F.col("__p33")) & (h <= F.col("__p67"))),
        "font_large": share(lambda h: h > F.col("__p67")),
        "margin_left": side(F.array_min("__left") / width), "margin_right": side((width - F.array_max("__right")) / width),
        "margin_top": side(F.array_min("__top") / height), "margin_bottom": side((height - F.array_max("__bottom")) / height)})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def analysis_json(docs: DataFrame) -> DataFrame:
    """Adds ``analysis``: the nested result document as JSON text."""
    c = F.col
    body = F.struct(
        F.struct(c("document_id").alias("name"), c("document_type").alias("class"), c("classification_confidence"), c("pages"), c("language")).alias("document_info"),
        F.struct(c("full_text"), c("text_blocks"), c("tables"), c("ocr_fields").alias("structured_fields")).alias("ocr_results"),
        F.struct(c("document_type").alias("predicted_class"), c("document_type"), c("classification_confidence").alias("confidence")).alias("classification_results"),
        F.struct(high_confidence(c("ocr_fields")).alias("high_confidence_fields"), table_summaries(c("tables")).alias("table_summaries"),
                 handwritten_summary(c("text_blocks")).alias("handwritten_content")).alias("custom_analysis"),
        F.struct(c("model_used"), c("processing_time"), c("confidence_scores")).alias("processing_metadata"))
    return docs.withColumn("analysis", F.to_json(body))


def high_confidence(fields: Column, threshold: float = 0.8) -> Column:
    return F.filter(fields, lambda f: f["confidence"] >= threshold)
