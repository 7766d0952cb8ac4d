"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

1. One pass over the texts gives each row its shingle-set size, a 128-bit identity of the set and a SuperMinHash
   signature. Rows with equal sets form a class; from here on only classes are compared.
2. Signatures are cut into bands; classes with an equal band meet in a bucket. In each bucket every class is compared
   with one pivot, so a bucket of n classes costs n pairs. Pairs that the signatures place clearly below the
   threshold go; the rest is verified on the full shingle sets of the two texts.
3. The links found are contracted to components. Only buckets that still hold more than one component go on: there the
   members outside the bucket's largest component are compared with all others, in tiles of a bounded number of
   rows, by a longer signature, in the first band whose bucket both are in; what passes and was not seen before is verified. So no partner is
   capped, and members of one component are never paired with each other again.
4. Components over all links; the smallest document id of a component names it.

Chance of losing a link: with 51 bands of 5 a pair at similarity 0.75 shares no band with a probability of 1e-6,
is estimated below 0.64 from 255 places with one of about 2e-5, and below 0.70 from 1024 places with one of 2e-4.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import keep
from foliant.llm.components import components
from foliant.llm.shingles import WORDS, mix64, shingle_sets, supermin


@dataclass(frozen=True)
class NearSpec:
    words: int = WORDS
    percent: int = 75
    places: int = 255
    bands: int = 51
    #: Pairs whose signatures agree less than this are not verified.
    screen: float = 0.64
    #: The longer signature, a multiple of 256 of half a byte each, and the agreement that is asked of it.
    long_places: int = 1024
    long_screen: float = 0.70
    #: Rows on either side of a tile.
    tile: int = 512
    #: Bytes of text handled at a time inside a task.
    chunk_bytes: int = 1 << 20


def _text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one text after the other, and where each ends; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets[1:] - offsets[0]


def _chunks(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is alone."""
    i = 0
    while i < len(ends):
        start = ends[i - 1] if i else 0
        j = max(int(np.searchsorted(ends, start + size, side="right")), i + 1)
        yield i, j
        i = j


def signatures(docs: DataFrame, spec: NearSpec) -> DataFrame:
    """From ``doc_id, text``: ``doc_id, th`` (a hash of the text), ``n_shingles, s1, s2`` (identity of the set), ``sig, bands``."""
    m, bands = spec.places, spec.bands
    rows = m // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = _text_buffer(batch.column("text"))
            for i, j in _chunks(ends, spec.chunk_bytes):
                start = ends[i - 1] if i else 0
                doc, value = shingle_sets(raw[start: ends[j - 1]], ends[i:j] - start, spec.words)
                sig = supermin(doc, value, j - i, m)
                n = np.bincount(doc, minlength=j - i)
                s1, s2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                np.add.at(s1, doc, mix64(value + np.uint64(1)))
                np.add.at(s2, doc, mix64(value ^ np.uint64(0x5851F42D4C957F2D)))
                parts = sig[:, : rows * bands].reshape(j - i, bands, rows).astype(np.uint64)
                key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((j - i, 1), np.uint64)
                for r in range(rows):
                    key = mix64(key ^ parts[:, :, r])
                low = np.ascontiguousarray(sig.astype(np.uint8))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
                cells = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.arange(j - i + 1, dtype=np.int32) * m), pa.py_buffer(low)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(n.astype(np.int64)),
                     pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), cells, lists],
                    names=["doc_id", "th", "n_shingles", "s1", "s2", "sig", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, th bigint, n_shingles bigint, s1 bigint, s2 bigint, sig binary, bands array<bigint>")


def _screened(pairs: DataFrame, sigs: DataFrame, spec: NearSpec) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree at enough places."""
    m, least = spec.places, spec.screen * spec.places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, m) for c in ("sa", "sb"))
            go = pa.array((x == y).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(go)

    both = pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a")
    both = both.join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, spec: NearSpec) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                sides = []
                for c in ("ta", "tb"):
                    raw, ends = _text_buffer(part.column(c))
                    doc, value = shingle_sets(raw, ends, spec.words)
                    sides.append((doc, value, np.bincount(doc, minlength=len(part))))
                (d1, v1, n1), (d2, v2, n2) = sides
                doc, value = np.concatenate((d1, d2)), np.concatenate((v1, v2))
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                same = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
                common = np.bincount(doc[1:][same], minlength=len(part))
                yield part.select(["a", "b"]).filter(pa.array((100 * common >= spec.percent * (n1 + n2 - common)) & (common > 0)))

    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _long_signatures(texts: DataFrame, spec: NearSpec) -> DataFrame:
    """``cid, fine``: the longer signature of each text, of signatures under several hashes, the low four bits of two places in a byte."""
    m = spec.long_places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = _text_buffer(batch.column("text"))
            for i, j in _chunks(ends, spec.chunk_bytes // 2):
                start = ends[i - 1] if i else 0
                doc, value = shingle_sets(raw[start: ends[j - 1]], ends[i:j] - start, spec.words)
                low = np.concatenate([supermin(doc, mix64(value + np.uint64(k)), j - i, 256) & 15 for k in range(1, m // 256 + 1)], axis=1)
                fine = (low[:, 0::2] << 4 | low[:, 1::2]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(i, j - i), pa.array([x.tobytes() for x in fine], pa.binary())], names=["cid", "fine"])

    return texts.select("cid", "text").mapInArrow(run, "cid bigint, fine binary")


def _packed_keys(classes: DataFrame) -> DataFrame:
    """``cid, keys``: the buckets of each class in the order of its bands, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([np.array(x, np.int64).tobytes() for x in batch.column("bands").to_pylist()], pa.binary())], names=["cid", "keys"])

    return classes.select("cid", "bands").mapInArrow(run, "cid bigint, keys binary")


def _across(members: DataFrame, spec: NearSpec) -> DataFrame:
    """Pairs across components inside each tile that the signatures let pass, each in one tile only.

    ``members``: ``bucket, band, tile, cid, root, side, keys, fine``, sides 0 and 1; ``keys`` are the buckets of all bands, 8 bytes each. A tile holds a bounded number of rows. Pairs are
    made of side 0 with side 1, and inside side 0 where the tile has no side 1.
    """
    # Two halves of a byte that differ still agree by chance once in sixteen.
    least = spec.long_places * (spec.long_screen + (1 - spec.long_screen) / 16)
    names = ["bucket", "band", "tile", "cid", "root", "side", "keys", "fine"]

    def pairs_of(band, cid, root, side, keys, fine):
        left = np.nonzero(side == 0)[0]
        right = np.nonzero(side == 1)[0]
        alone = not len(right)
        right = left if alone else right
        for p, i in enumerate(left):
            others = right[p + 1:] if alone else right
            others = others[root[others] != root[i]]
            differ = fine[others] ^ fine[i]
            others = others[((differ & 15) == 0).sum(axis=1) + ((differ & 240) == 0).sum(axis=1) >= least]
            if len(others):
                others = others[(keys[others] == keys[i]).argmax(axis=1) == band]
            for o in others:
                yield min(cid[i], cid[o]), max(cid[i], cid[o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch.select(names)])
            held = t if held is None else pa.concat_tables([held, t])
            key = np.stack([held.column(c).to_numpy() for c in ("bucket", "tile")])
            starts = np.concatenate(([0], np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1)) if held.num_rows else np.zeros(1, int)
            if len(starts) > 1:
                yield from out(held.slice(0, starts[-1]), starts)
                held = held.slice(starts[-1]).combine_chunks()
        if held is not None and held.num_rows:
            yield from out(held, np.array([0, held.num_rows]))

    def out(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        band, cid, root, side = (t.column(c).to_numpy() for c in ("band", "cid", "root", "side"))
        keys, fine = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1) for c, kind in (("keys", np.int64), ("fine", np.uint8)))
        found = [p for s, e in zip(starts[:-1], starts[1:]) for p in pairs_of(band[s], cid[s:e], root[s:e], side[s:e], keys[s:e], fine[s:e])]
        for i in range(0, len(found), 10_000):
            a, b = np.array(found[i: i + 10_000], dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    n = members.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = members.repartition(int(n), "bucket", "tile").sortWithinPartitions("bucket", "tile")
    return dealt.select(*names).mapInArrow(run, "a bigint, b bigint")


def _tiles(buckets: DataFrame, roots: DataFrame, spec: NearSpec) -> DataFrame:
    """The members of buckets that hold several components, dealt to tiles."""
    rows = buckets.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rows = keep(rows, "bucket-roots")
    parts = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    heads = keep(parts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
                 .where("k > 1").select("bucket", F.col("top.root").alias("main"), F.ceil(F.col("top.n") / spec.tile).cast("int").alias("mains"),
                                        F.ceil((F.col("all") - F.col("top.n")) / spec.tile).cast("int").alias("others")), "bucket-heads")
    rows = rows.join(heads, "bucket")
    # Tile (i, j): the i-th part of the members outside the main component with its j-th part, or (negative) with themselves.
    inside = F.col("root") == F.col("main")
    own = F.when(inside, F.pmod(F.xxhash64("cid"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("others"))).cast("int")
    rows = rows.withColumn("own", own)
    main = rows.where(inside).select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("o")).select(
        "bucket", "band", F.concat_ws(",", "o", "own").alias("at"), "cid", "root", F.lit(1).alias("side"))
    with_main = rows.where(~inside).select("*", F.explode(F.sequence(F.lit(0), F.col("mains") - 1)).alias("o")).select(
        "bucket", "band", F.concat_ws(",", "own", "o").alias("at"), "cid", "root", F.lit(0).alias("side"))
    several = rows.where(~inside & (F.col("others") >= 1)).select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("o"))
    among = several.select("bucket", "band", F.concat_ws(",", F.lit("o"), F.least("own", "o"), F.greatest("own", "o")).alias("at"), "cid", "root",
                           F.when(F.col("own") <= F.col("o"), 0).otherwise(1).alias("side"))
    return main.union(with_main).union(among).withColumn("tile", F.xxhash64("at")).drop("at")


def near_duplicates(docs: DataFrame, spec: NearSpec = NearSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``, and the class as ``s1, s2``.

    A null or empty text, or one of white space, has no shingles and is linked with nothing: its component is
    its own id. Rows that are there twice are in one class. A null id counts for nothing when the smallest id of a
    component is taken. Other columns of the input are not looked at; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = keep(signatures(slim, spec), "signatures")
    some = rows.where("n_shingles > 0")
    classes = keep(
        some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "th")).alias("one"),
                                                    F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    memberships = classes.select("cid", F.posexplode("bands").alias("band", "bucket"))
    pivots = keep(memberships.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("p"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1").select("bucket", F.col("p.cid").alias("pivot")), "pivots")
    buckets = keep(memberships.join(pivots, "bucket"), "buckets")
    sigs = classes.select("cid", "sig")
    star = buckets.where("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    star = keep(_screened(star, sigs, spec), "star-pairs")
    texts = keep(_texts_of(slim, classes, buckets), "texts")
    links = keep(_verified(star, texts, spec), "star-links")

    tiles = keep(_tiles(buckets.drop("pivot"), components(links), spec), "tiles")
    fine = keep(_long_signatures(texts.join(tiles.select("cid").distinct(), "cid", "left_semi"), spec), "long-signatures")
    members = tiles.join(keep(_packed_keys(classes).join(fine, "cid"), "keys-and-signatures"), "cid")
    across = keep(_across(members, spec).distinct().join(star, ["a", "b"], "left_anti"), "cross-pairs")
    links = links.union(keep(_verified(across, texts, spec), "cross-links"))
    roots = components(links)

    named = classes.join(roots, classes["cid"] == roots["node"], "left").select("s1", "s2", "n_shingles", "low", F.coalesce("root", "cid").alias("root"))
    least = keep(named.groupBy("root").agg(F.min("low").alias("component_id")), "component-ids")
    by_class = keep(named.join(least, "root").select("s1", "s2", "n_shingles", "component_id"), "class-components")
    out = some.join(by_class, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", "component_id", "s1", "s2", "th")
    out = out.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "s1", "s2", "th"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "s1", "s2", "th")


def _texts_of(slim: DataFrame, classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """A text for each class that is in a bucket with another."""
    wanted = classes.join(buckets.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("one.doc_id").alias("__id"), F.col("one.th").alias("__th"))
    found = slim.join(wanted, slim["doc_id"].eqNullSafe(wanted["__id"]) & (slim["th"] == wanted["__th"]))
    return found.select("cid", "text").dropDuplicates(["cid"])


def drop_near_copies(docs: DataFrame, spec: NearSpec = NearSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each component (the smallest id), with all their columns; documents without words stay."""
    found = keep(near_duplicates(docs, spec, id_col, text_col), "components")
    stay = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    out = docs.withColumn("__text_hash", F.xxhash64(text_col))
    out = out.join(stay, out[id_col].eqNullSafe(stay["__id"]) & (out["__text_hash"] == stay["__th"]), "left_semi")
    if not found.where("kept and n_shingles > 0").groupBy("component_id").count().where("count > 1").isEmpty():
        out = _one_of_each(out, found, id_col)
    return out.drop("__text_hash")


def _one_of_each(out: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Where an id is there more than once in a component, one of its rows; all other rows as they are."""
    again = found.where("kept and n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(
        F.min("th").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    again = keep(again, "repeated")
    once = out.join(again, out[id_col] == again["__id"], "left_anti")
    several = out.join(again, (out[id_col] == again["__id"]) & (out["__text_hash"] == again["__first"]), "left_semi")
    return once.union(several.dropDuplicates([id_col, "__text_hash"]))
