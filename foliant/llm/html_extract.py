"""Main text of web pages by template deduction over equivalence classes.

Pages of one host are taken as made by one template. Tokens are the element paths of a page (with class names) and its
whole text blocks. Tokens with the same occurrence vector, the number of occurrences on each page of the host, form an equivalence class;
one of at least two element paths on enough of the host's pages is valid. Vectors are compared by a sum of hashes per
page, so a class over any number of pages is found by one grouped aggregation. Valid classes nest by their paths into the
template. Text blocks that hang below it are its slots, inside article and main elements as well as outside.

A text is fixed if it recurs in its slot on most of the slot's different pages. Copies of a page are no different pages: a
text's pages are told apart by the longest other texts that stand with it, so the paragraphs of an article that is
there a thousand times have one page. A slot of mostly fixed texts is a constant part of the template (menu, advert,
notice); in the other slots, which the pages were made to carry, only fixed texts go.

Of the rest, what an article element (or main) holds is the article, else all of it. Adverts and comments that differ from page to page
look like articles to the template: names of elements, roles and classes tell them, and decide alone where a host has too few pages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import keep
from foliant.llm.html_text import article, read_page, text_hash
from foliant.llm.url_filter import host_of


@dataclass(frozen=True)
class TemplateSpec:
    #: A valid class is on so many pages, and so many hundredths of the host's.
    min_pages: int = 8
    min_percent: int = 20
    #: A slot in which texts that are not fixed are less than this part of all, in hundredths, is constant.
    max_variety_percent: int = 50
    #: A fixed text is on more than so many hundredths of its slot's different pages.
    min_fixed_percent: int = 50


#: So many of a page's longest texts tell it from other pages.
LONGEST = 3


def tokens(pages: DataFrame) -> DataFrame:
    """From ``row, host, html``: a row per page and token: ``row, host, path, parent, text, n, body, c0, c1, c2``; ``parent`` and all after ``n`` are null for an element.

    ``body`` stands for the page's longest texts, ``c0`` to ``c2`` are the longest of them apart from the token's own (the first again where there are fewer).
    """
    names = ["row", "host", "path", "parent", "text", "n", "body", *(f"c{i}" for i in range(LONGEST))]
    types = [pa.string() if c == "host" else pa.int64() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = tuple([] for _ in names)
            for key, host, page in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "html"))):
                blocks, tags = read_page(page or "")
                hashed = [text_hash(b.text) for b in blocks]
                length = {h: len(b.text) for h, b in zip(hashed, blocks) if not b.skip}
                longest = sorted(length, key=lambda h: (-length[h], h))[: LONGEST + 1]
                body = xxhash.xxh64_intdigest(repr(longest[:LONGEST])) >> 1
                found = Counter((b.slot, b.parent, h) for h, b in zip(hashed, blocks))
                items = [(p, None, None, n, *[None] * (LONGEST + 1)) for p, n in tags.items()]
                for (path, parent, text), n in found.items():
                    others = [h for h in longest if h != text][:LONGEST]
                    items.append((path, parent, text, n, body, *(others[:1] or [None]) * (LONGEST - len(others)), *others))
                for item in items:
                    for out, v in zip(rows, (key, host, *item)):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=names)

    return pages.select("row", "host", "html").mapInArrow(run, ", ".join(f"{c} {'string' if c == 'host' else 'bigint'}" for c in names))


def constant_slots(pages: DataFrame, spec: TemplateSpec) -> DataFrame:
    """``host, constant``: the constant slots of each host's template, and slot and text, as one number, of the fixed texts in its other slots."""
    found = keep(tokens(pages), "page-tokens")
    elements = keep(found.where("text is null").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("row", "n")).alias("vector")), "elements")
    of_host = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    # Equivalence classes: elements with one vector. Two of them, on enough pages, are part of the template.
    classes = elements.groupBy("host", "vector", "pages", "n").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") >= 2) & (F.col("pages") >= spec.min_pages))
    classes = keep(classes.join(of_host, "host").where(F.col("pages") * 100 >= F.col("all") * spec.min_percent).drop("all", "size"), "classes")
    template = keep(elements.join(classes, ["host", "vector", "pages", "n"]).select("host", F.col("path").alias("place")), "template")
    # On how many different pages each text and each slot is.
    slot = ["host", "path", "parent"]
    blocks = found.where("text is not null")
    texts = blocks.groupBy(*slot, "text").agg(*[F.count_distinct(f"c{i}").alias(f"c{i}") for i in range(LONGEST)])
    # The middle count: one long text that is the same, or one advert that changes, does not decide.
    texts = texts.select(*slot, "text", F.sort_array(F.array(*[f"c{i}" for i in range(LONGEST)]))[LONGEST // 2].alias("on"))
    texts = keep(texts, "slot-texts")
    slots = blocks.groupBy(*slot).agg(F.count_distinct("body").alias("bodies")).where(F.col("bodies") >= spec.min_pages)
    slots = slots.join(texts.groupBy(*slot).agg(F.sum(F.greatest("on", F.lit(1))).alias("all")), slot)
    fixed = texts.where(F.col("on") >= spec.min_pages).join(slots, slot).where(F.col("on") * 100 > F.col("bodies") * spec.min_fixed_percent)
    fixed = keep(fixed, "fixed-texts")
    # A slot is nested in the template if its own element or the one around it is in a valid class.
    slots = fixed.groupBy(*slot, "all").agg(F.sum("on").alias("held")).select(
        *slot, ((F.col("all") - F.col("held")) * 100 < F.col("all") * spec.max_variety_percent).alias("whole"), F.explode(F.array("path", "parent")).alias("place"))
    slots = keep(slots.join(template, ["host", "place"], "left_semi").drop("place").distinct(), "slots")
    parts = fixed.join(slots.where("not whole"), slot).select("host", F.col("path").bitwiseXOR(F.col("text")).alias("part"))
    return slots.where("whole").select("host", F.col("path").alias("part")).union(parts).groupBy("host").agg(F.collect_set("part").alias("constant"))


def extract(pages: DataFrame, spec: TemplateSpec = TemplateSpec(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Blocks are trimmed, white space inside one is one space, and blocks are joined by a line feed. A null or empty page, or one
    without an article, gives the empty text. A null URL, or one without a host, counts as the empty host; a null id stays null.
    Pages that are there twice are extracted twice. Other columns of the input are not looked at; an empty table gives an empty
    result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    slots = keep(constant_slots(rows.withColumn("row", F.monotonically_increasing_id()), spec), "constant-slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[tuple, frozenset[int]] = {}
            texts = []
            for page, constant in zip(batch.column("html").to_pylist(), batch.column("constant").to_pylist()):
                key = tuple(constant or ())
                texts.append("\n".join(article(read_page(page or "")[0], sets.setdefault(key, frozenset(key)))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.join(slots, "host", "left").select("page_id", "url", "html", "constant").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
