"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. Blocks are sorted by (hash, content) and named by
integers in that order, so two blocks have one name exactly if their content is the same. Then adjacent
names are paired and the distinct pairs named in the same way, until each document has one name. A name
is an identity, not a fingerprint: a hash only orders the blocks, and where two contents share one hash
they are ranked by content. For that each content crosses the network once, combined per map task first.

Documents whose text is one block never enter the pairing; the others halve their number of names per
level, so the longest text sets the number of levels (its logarithm), each a job over names alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import keep, lower_ascii

BLOCK_CHARS = 8192


def _blocks(docs: DataFrame, block_chars: int, hash_bits: int) -> DataFrame:
    """The blocks of each text in order, with their hash and the place of the last; an empty text is one empty block."""
    last = F.greatest(F.ceil(F.char_length("norm") / block_chars).cast("int") - 1, F.lit(0))
    cuts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("norm"), i * block_chars + 1, F.lit(block_chars)))
    rows = docs.select("*", last.alias("last"), F.posexplode(cuts).alias("pos", "block")).drop("norm")
    h = F.xxhash64("block")
    return rows.withColumn("h", h if hash_bits == 64 else F.pmod(h, F.lit(2**hash_bits)))


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
                   hash_bits: int = 64) -> DataFrame:
    """One row per input row: ``rid`` (a row number of its own), the id, ``text_sha256``, and ``level`` and
    ``name``, which two rows share exactly if their normalised texts are equal. ``hash_bits`` is for tests."""
    source = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.col(text_col)).alias("norm"))
    source = source.withColumn("text_sha256", F.sha2("norm", 256))
    blocks = keep(_blocks(source.withColumn("rid", F.monotonically_increasing_id()), block_chars, hash_bits).drop("block"), "blocks")

    # Where one hash stands for more than one content, contents are ranked within it.
    contents = _blocks(source.select("norm"), block_chars, hash_bits).groupBy("h").agg(F.min("block").alias("a"), F.max("block").alias("b"))
    shared = keep(contents.where("a != b").select("h"), "shared-hashes")
    ranked = blocks.withColumn("r", F.lit(0))
    if not shared.isEmpty():
        ranked = _rank_shared(source, shared, blocks, block_chars, hash_bits)
    # Texts are not needed from here on: every later job sees integers only.
    names = _named(ranked, ["h", "r"])
    return _pair_up(keep(ranked.join(names, ["h", "r"]).select("rid", "doc_id", "text_sha256", "pos", "last", "name"), "level-0"))


def _rank_shared(source: DataFrame, shared: DataFrame, blocks: DataFrame, block_chars: int, hash_bits: int) -> DataFrame:
    """The blocks with ``r``: the place of a content among the contents that have its hash."""
    hit = _blocks(source, block_chars, hash_bits).join(shared, "h", "left_semi")
    order = hit.select("h", "block").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("block")) - 1)
    place = hit.join(order, ["h", "block"]).select("text_sha256", "pos", "r").distinct()
    return blocks.join(place, ["text_sha256", "pos"], "left").select(*blocks.columns, F.coalesce("r", F.lit(0)).alias("r"))


def _named(parts: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct parts with integer names that follow their sorted order."""
    return parts.select(*cols).distinct().orderBy(*cols).withColumn("name", F.monotonically_increasing_id())


def _pair_up(level: DataFrame) -> DataFrame:
    """Name adjacent pairs, level by level, until each row has one name."""
    row = ["rid", "doc_id", "text_sha256"]
    most = level.agg(F.max("last")).first()[0] or 0
    done = [level.where("last = 0").select(*row, F.lit(0).alias("level"), "name")]
    depth = 0
    while most:
        depth, most = depth + 1, most // 2
        pairs = (
            level.where("last > 0").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(*[F.first(c).alias(c) for c in row[1:]], F.floor(F.first("last") / 2).cast("int").alias("last"),
                 F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                 F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        level = keep(pairs.join(_named(pairs, ["a", "b"]), ["a", "b"]).select(*row, "pos", "last", "name"), f"level-{depth}")
        done.append(level.where("last = 0").select(*row, F.lit(depth).alias("level"), "name"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Which rows have the same text, up to the case of A-Z, and which of them stays.

    One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Of equal texts the row with the
    largest id stays. A null text is an empty one; empty texts are equal to each other. A null id comes before
    every other id. A row that is there twice, id included, is kept once. Other columns of the input, whatever
    their names, are not looked at. An empty table gives an empty result.
    """
    named = name_documents(docs, id_col, text_col, block_chars)
    groups = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = keep(groups, "groups")  # a join of two exchanges, so a large group's rows can be split
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that stay, with all their columns; the same ones as in ``exact_dedup``."""
    named = keep(name_documents(docs, id_col, text_col, block_chars), "names")
    stay = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.first("text_sha256").alias("__sha"))
    stay = stay.select(F.col("top.doc_id").alias("__id"), F.col("__sha").alias("__stay"))
    docs = docs.withColumn("__sha", F.sha2(lower_ascii(F.col(text_col)), 256))
    out = docs.join(stay, docs[id_col].eqNullSafe(stay["__id"]) & (docs["__sha"] == stay["__stay"]), "left_semi")
    if not named.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__sha"])  # a row that is there twice
    return out.drop("__sha")
