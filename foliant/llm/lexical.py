"""Ranked lexical search: Block-Max MaxScore over compressed postings.

Documents are indexed in shards of a bounded size, each by the task that reads them, so no text is shuffled. A term's
postings in a shard are cut into blocks of 128; a block keeps its last document, its impacts (the pairs of frequency and length
that no other pair of the block beats, so its highest score can be told without reading it, for any corpus statistics) and its
postings in as many bytes as its largest number needs.

A shard searches a block of queries over windows of documents. A term's highest score in the shard is its global bound. The terms
with the smallest bounds, whose sum does not beat the worst of the best k so far, are not essential: only the other lists
are read through. What these find is a candidate, and the lists that are not essential are asked for it from the highest bound
to the lowest: a candidate goes when its score, the maximum of the block that it would be in and the bounds of the lists still to be
asked cannot beat the worst; blocks without a candidate are never decompressed. The best k of each shard meet in a ranking per query.

Equal scores are ranked by document, and a shard's documents are numbered in that order, so a later document must score more to enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import keep, lower_ascii
from foliant.llm.wordcodes import BY_SIGNS, Chunk, chunks

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ROWS = 50_000


@dataclass(frozen=True)
class LexicalSpec:
    k: int = 50
    #: A shard ends at so many terms (with repeats) or documents.
    shard_words: int = 3_000_000
    shard_docs: int = 65_536
    #: Postings of a block, and documents of a window.
    block: int = 128
    window: int = 4_096
    #: Queries that are searched together, about.
    query_block: int = 1_024
    #: Decompressed blocks that a shard holds.
    cached: int = 4_096


def terms_of(text: Column) -> Column:
    """Terms of a text, with repeats; null has none."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def _bytes_list(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at ``ends`` of ``data``."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _packed(blocks: np.ndarray, streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' bytes: a head that tells the width of each stream's numbers, then the streams. ``blocks``: where each starts."""
    n = len(streams[0])
    sizes = np.diff(np.concatenate((blocks, [n])))
    widths = [np.choose((np.maximum.reduceat(s, blocks) > 0xFF).astype(int) + (np.maximum.reduceat(s, blocks) > 0xFFFF), (1, 2, 4)) for s in streams]
    total = 1 + sum(w * sizes for w in widths)
    ends = np.cumsum(total)
    out = np.zeros(int(ends[-1]), dtype=np.uint8)
    start = ends - total
    out[start] = sum((np.log2(w).astype(np.int64) << (2 * i)) for i, w in enumerate(widths))
    inside = np.arange(n) - np.repeat(blocks, sizes)
    at = start + 1
    for s, w in zip(streams, widths):
        each = np.repeat(w, sizes)
        place = np.repeat(at, sizes) + inside * each
        for k in range(4):
            wide = each > k
            if not wide.any():
                break
            out[place[wide] + k] = (s[wide] >> (8 * k)) & 0xFF
        at = at + w * sizes
    return out, ends


def unpack(block: bytes, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, frequencies and document lengths of a block whose list has come to document ``before``."""
    widths = [1 << ((block[0] >> (2 * i)) & 3) for i in range(3)]
    n, at, out = (len(block) - 1) // sum(widths), 1, []
    for w in widths:
        out.append(np.frombuffer(block, dtype=f"<u{w}", count=n, offset=at).astype(np.int64))
        at += n * w
    return np.cumsum(out[0]) + before, out[1], out[2]


def _impacts(block_of: np.ndarray, tf: np.ndarray, rank: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per block the pairs (frequency, length) that no other beats, as bytes and ends. ``rank``: of a posting's length among ``lengths``."""
    few, some = int(len(lengths)).bit_length(), int(tf.max()).bit_length()
    if few + some + int(block_of[-1]).bit_length() < 63:
        key = np.sort((((block_of << some) | ((1 << some) - 1 - tf)) << few) | rank)
        rank, rest = key & ((1 << few) - 1), key >> few
        block_of, tf = rest >> some, (1 << some) - 1 - (rest & ((1 << some) - 1))
    else:
        order = np.lexsort((rank, -tf, block_of))
        block_of, tf, rank = block_of[order], tf[order], rank[order]
    # Of falling frequencies, those whose length is shorter than all before; a block's numbers lie below those of the one before.
    low = rank - block_of * (len(lengths) + 1)
    best = np.ones(len(low), dtype=bool)
    best[1:] = low[1:] < np.minimum.accumulate(low)[:-1]
    pairs = np.column_stack((tf[best], lengths[rank[best]])).astype("<u4")
    return pairs.reshape(-1).view(np.uint8), np.cumsum(np.bincount(block_of[best])) * 8


def _shard_rows(chunk: Chunk, spec: LexicalSpec, id_type: pa.DataType, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    order = pc.sort_indices(chunk.table().column("doc"), null_placement="at_start").to_numpy()
    ids, n = chunk.table().column("doc").take(pa.array(order)), chunk.lengths()[order]
    docs = pa.StructArray.from_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(n)], ["doc", "n"])
    whole = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
    none = [pa.nulls(1, schema.field(c).type) for c in ("term", "df", "last", "impacts", "blocks")]
    yield pa.RecordBatch.from_arrays([pa.array([chunk.number]), *none, whole.cast(schema.field("docs").type)], schema=schema)
    if not chunk.n_words:
        return
    codes = np.concatenate([chunk.words[i] for i in order]).astype(np.int64)
    key, tf = np.unique(codes * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    code, doc = np.divmod(key, len(n))
    lists = np.nonzero(np.diff(code, prepend=-1))[0]
    sizes = np.diff(np.concatenate((lists, [len(code)])))
    place = np.arange(len(code)) - np.repeat(lists, sizes)
    blocks = np.nonzero(place % spec.block == 0)[0]
    step = np.diff(doc, prepend=-1)
    step[lists] = doc[lists] + 1
    lengths, rank = np.unique(n, return_inverse=True)
    block_of = np.repeat(np.arange(len(blocks)), np.diff(np.concatenate((blocks, [len(code)]))))
    packed, pairs = _bytes_list(*_packed(blocks, [step, tf, n[doc]])), _bytes_list(*_impacts(block_of, tf, rank[doc], lengths))
    per_list = -(-sizes // spec.block)
    upto = np.concatenate(([0], np.cumsum(per_list)))
    last = doc[np.concatenate((blocks[1:], [len(code)])) - 1].astype("<u4")
    lasts = _bytes_list(last.view(np.uint8), upto[1:] * 4)
    words = chunk.vocabulary()  # codes are given without gaps, so there is a list for each
    for at in range(0, len(words), _ROWS):
        rows = min(_ROWS, len(words) - at)
        part = slice(int(upto[at]), int(upto[at + rows]))
        offsets = pa.array((upto[at: at + rows + 1] - upto[at]).astype(np.int32))
        nested = [pa.ListArray.from_arrays(offsets, x[part]).cast(schema.field("blocks").type) for x in (pairs, packed)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, chunk.number)), words[at: at + rows], pa.array(sizes[at: at + rows].astype(np.int32)),
                                          lasts[at: at + rows], *nested, pa.nulls(rows, schema.field("docs").type)], schema=schema)


def build_index(docs: DataFrame, spec: LexicalSpec = LexicalSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, kept in the shared folder: per shard and term ``shard, term, df, last, impacts, blocks``, and per shard a
    row without a term that holds ``docs``, the id and the number of terms of each document by its number.

    A null text has no terms. Rows with one id are documents of their own; a null id comes first among equals. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType
    out = (f"shard bigint, term string, df int, last binary, impacts array<binary>, blocks array<binary>, docs array<struct<doc {kind.simpleString()}, n bigint>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for chunk in chunks(batches, "text", BY_SIGNS, spec.shard_words, spec.shard_docs):
            id_type = chunk.table().schema.field("doc").type
            binaries = pa.list_(pa.binary())
            schema = schema or pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("last", pa.binary()), ("impacts", binaries),
                                          ("blocks", binaries), ("docs", pa.list_(pa.struct([("doc", id_type), ("n", pa.int64())])))])
            yield from _shard_rows(chunk, spec, id_type, schema)

    return keep(rows.mapInArrow(run, out), "lexical-index")


@dataclass
class _List:
    """A term's postings in a shard."""

    last: np.ndarray
    top: np.ndarray  # of each block, the highest score without the term's weight
    blocks: list[bytes]


class _Shard:
    def __init__(self, lists: list[_List], corpus: tuple[int, int], spec: LexicalSpec) -> None:
        self.lists, self.corpus, self.spec = lists, corpus, spec
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, i: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block, and their scores without the term's weight."""
        if (i, b) not in self.held:
            if len(self.held) >= self.spec.cached:
                self.held.clear()
            x = self.lists[i]
            doc, tf, n = unpack(x.blocks[b], int(x.last[b - 1]) if b else -1)
            self.held[i, b] = doc, part(tf, n, self.corpus)
        return self.held[i, b]

    def search(self, asked: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The best documents, and their scores, for the lists and weights ``asked``."""
        k, size = self.spec.k, self.spec.window
        asked = sorted(asked, key=lambda a: a[1] * int(self.lists[a[0]].top.max()))
        sums = np.concatenate(([0], np.cumsum([w * int(self.lists[i].top.max()) for i, w in asked])))
        best, score, worst = np.empty(0, np.int64), np.empty(0, np.int64), 0
        end = 1 + max(int(self.lists[i].last[-1]) for i, _ in asked)
        for lo in range(0, end, size):
            essential = int(np.searchsorted(sums[1:], worst, side="right"))
            if essential == len(asked):
                break
            found = np.zeros(size, dtype=np.int64)
            for i, w in asked[essential:]:
                last = self.lists[i].last
                for b in range(int(np.searchsorted(last, lo)), min(int(np.searchsorted(last, lo + size - 1)) + 1, len(last))):
                    doc, s = self.postings(i, b)
                    a, z = np.searchsorted(doc, (lo, lo + size))
                    found[doc[a:z] - lo] += w * s[a:z]
            doc = np.nonzero(found)[0]
            total = found[doc]
            doc = doc + lo
            for at in range(essential - 1, -1, -1):
                i, w = asked[at]
                x = self.lists[i]
                b = np.searchsorted(x.last, doc)
                most = w * np.concatenate((x.top, [0]))[b]
                stay = total + most + sums[at] > worst
                doc, total, b = doc[stay], total[stay], b[stay]
                for one in np.unique(b[b < len(x.last)]).tolist():
                    here = np.nonzero(b == one)[0]
                    there, s = self.postings(i, one)
                    p = np.minimum(np.searchsorted(there, doc[here]), len(there) - 1)
                    total[here] += np.where(there[p] == doc[here], w * s[p], 0)
            better = total > worst
            best, score = np.concatenate((best, doc[better])), np.concatenate((score, total[better]))
            if len(best) > k:
                first = np.lexsort((best, -score))[:k]
                best, score = best[first], score[first]
            if len(best) == k:
                worst = int(score.min())
        return best, score


def part(tf: np.ndarray, n: np.ndarray, corpus: tuple[int, int]) -> np.ndarray:
    """Score of a posting without the term's weight. ``corpus``: documents with a term, terms of all documents."""
    docs, words = corpus
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))


def search(index: DataFrame, items: DataFrame, spec: LexicalSpec = LexicalSpec(), item_col: str = "item_id", text_col: str = "text", doc_name: str = "doc_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item, highest score first, equal ones by document (null first).

    Rows with one item id, the null id too, are one item with the terms of all; an item without terms that any document holds has
    no row. Only scores above 0 count. Empty tables give an empty result.
    """
    shards = index.where("term is null").select("shard", F.posexplode("docs").alias("number", "d")).select("shard", "number", "d.doc", "d.n")
    sizes = shards.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    corpus = int(sizes["docs"]), int(sizes["words"])
    asked = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term")).distinct()
    asked = keep(asked, "lexical-terms")
    lists = index.where("term is not null").join(asked.select("term").distinct(), "term", "left_semi").select("shard", "term", "df", "last", "impacts", "blocks")
    lists = keep(lists, "lexical-lists")
    weight = F.floor(1000 * F.log((2 * F.lit(corpus[0]) + 2).cast("double") / (2 * F.sum("df") + 1))).cast("long")
    weights = lists.groupBy("term").agg(weight.alias("w")).where("w > 0")
    blocks = max(-(-asked.select("item").distinct().count() // spec.query_block), 1)
    part_of = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    asks = asked.join(weights, "term").groupBy("term", part_of.alias("part")).agg(F.collect_list(F.struct("item", "w")).alias("asks"))
    kind = asked.schema["item"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        lists, queries = [], {}
        for i, (last, impacts, data, asks) in enumerate(zip(*(table.column(c).to_pylist() for c in ("last", "impacts", "blocks", "asks")))):
            pairs = np.frombuffer(b"".join(impacts), dtype="<u4").reshape(-1, 2).astype(np.int64)
            starts = np.cumsum([0] + [len(x) // 8 for x in impacts[:-1]])
            lists.append(_List(np.frombuffer(last, dtype="<u4").astype(np.int64), np.maximum.reduceat(part(pairs[:, 0], pairs[:, 1], corpus), starts), data))
            for a in asks:
                queries.setdefault(a["item"], []).append((i, a["w"]))
        shard = _Shard(lists, corpus, spec)
        found = [(item, *shard.search(q)) for item, q in queries.items()]
        item_type = table.schema.field("asks").type.value_type.field("item").type
        counts = [len(d) for _, d, _ in found]
        return pa.table({
            "item": pa.array([x for (x, _, _), n in zip(found, counts) for _ in range(n)], item_type),
            "shard": pa.array(np.full(sum(counts), table.column("shard")[0].as_py())),
            "number": pa.array(np.concatenate([d for _, d, _ in found]).astype(np.int32)),
            "score": pa.array(np.concatenate([s for _, _, s in found]))})

    best = lists.join(asks, "term").groupBy("shard", "part").applyInArrow(run, f"item {kind}, shard bigint, number int, score bigint")
    named = best.join(shards.select("shard", "number", "doc"), ["shard", "number"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return named.withColumn("rank", rank).where(F.col("rank") <= spec.k).select(
        F.col("item").alias(item_col), "rank", F.col("doc").alias(doc_name), "score")
