"""Language-model scores from a Bloom filter of logarithmic counts.

The model's counts of n-grams live in a Bloom filter alone; those of single words are known exactly, as the base score asks for them. A
count is quantised to a level on a logarithmic scale, and the n-gram is put into the filter once for each level up to its own. To
read a count, levels are asked for from the first on until one is absent; the level stands for the mean of the counts that share it.
The filter never says less than was put in, and says more with a chance that falls with each level. Probabilities are
interpolated from the shortest n-grams to the longest (Dirichlet priors): p(w | h) = (c(h w) + s p(w | shorter h)) / (c(h) + s).

Documents are dealt to chunks by the tasks that read them, with a code for each distinct word of a chunk. A chunk sums its own words
and n-grams first and sends each one once, packed together by the hash that deals them to groups of some millions, whatever the
corpus; a frequent word or n-gram is one number per chunk. A filter whose proven size is small is broadcast to the workers, which
probe it. A larger one stays in slices: the n-grams of each chunk, which come to the slice to be counted anyway, are probed there; both
ways read the same bits.

Next to the model stands the exact base: add-0.1 probabilities of single words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import keep
from foliant.llm.wordcodes import BY_SPACE, Chunk, chunks

#: The hash of what stands before a text; the end of a text is word number 0 of each chunk, written as an empty word.
_BEGIN = np.uint64(0x9E3779B97F4A7C15)
_END = b""
_ODD = np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class LmSpec:
    #: Longest n-grams, and the strength of the shorter ones' probability.
    order: int = 2
    strength: float = 2.0
    #: Ratio of neighbouring count levels; hash functions for each level.
    base: float = 1.5
    hashes: int = 8
    #: A chunk ends at so many words or documents.
    chunk_words: int = 1_000_000
    chunk_docs: int = 65_536
    #: N-grams of a slice and words of a group, about, and bytes of a filter that may be broadcast.
    slice_grams: int = 2_000_000
    broadcast_bytes: int = 96_000_000
    #: A document is held out if crc32 of its id as text leaves no rest.
    held_out: int = 10

    @property
    def bits(self) -> float:
        """Bits for an entry at which half the filter is set."""
        return self.hashes / math.log(2)

    def levels(self) -> np.ndarray:
        """The smallest count of each level; whole numbers, each once, up to any count."""
        found = np.ceil(self.base ** np.arange(0, math.log(2**62) / math.log(self.base))).astype(np.int64)
        return np.unique(found)

    def counts(self) -> np.ndarray:
        """What a level stands for; level 0 is absence."""
        least = self.levels()
        return np.concatenate(([0.0], (least + np.concatenate((least[1:] - 1, least[-1:]))) / 2))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * _ODD
    return x ^ (x >> np.uint64(29))


def _entry(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of an n-gram at a level; the further ones are their sums."""
    a = _mix(grams + np.uint64(0xD6E8FEB86659FD93 * (level + 1) & 2**64 - 1))
    return a, _mix(a ^ _BEGIN) | np.uint64(1)


def slice_of(grams: np.ndarray, n: int) -> np.ndarray:
    return (_mix(grams ^ _ODD) % np.uint64(n)).astype(np.int64)


#: What a slice knows of an n-gram: 40 bits of its hash, which tell some millions apart better than the filter does.
_WIDTH = 5


def _packed(grams: np.ndarray) -> bytes:
    return _mix(grams).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _WIDTH, 8), dtype=np.uint8)
    out[:, :_WIDTH] = np.frombuffer(data, dtype=np.uint8).reshape(-1, _WIDTH)
    return out.reshape(-1).view("<u8")


def _short(grams: np.ndarray) -> np.ndarray:
    return _mix(grams) & np.uint64((1 << 8 * _WIDTH) - 1)


def _place(hashes: np.ndarray, size: int) -> np.ndarray:
    """A bit for each hash: its upper half as a share of the size, which is below 2**32."""
    return ((hashes >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def fill(grams: np.ndarray, counts: np.ndarray, spec: LmSpec) -> np.ndarray:
    """The slice, as bytes, that holds distinct n-grams with their counts."""
    level = np.searchsorted(spec.levels(), counts, side="right")
    size = max(64, int(math.ceil(level.sum() * spec.bits / 8)) * 8)
    bits = np.zeros(size, dtype=np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        a, b = _entry(grams[level >= j], j)
        for _ in range(spec.hashes):
            bits[_place(a, size)] = 1
            a += b
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, grams: np.ndarray, spec: LmSpec) -> np.ndarray:
    """The level of each n-gram."""
    size, level = len(bits) * 8, np.zeros(len(grams), dtype=np.uint8)
    there, j = np.arange(len(grams)), 1
    while len(there):
        a, b = _entry(grams[there], j)
        yes = np.ones(len(there), dtype=np.uint8)
        for _ in range(spec.hashes):
            at = _place(a, size)
            yes &= bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)
            a += b
        there = there[yes.view(np.bool_)]
        level[there] = j
        j += 1
    return level


def _begins(order: int) -> np.ndarray:
    """The n-grams that are nothing but the begin of a text, as contexts of its first word; the first is a single word."""
    return _mix(_BEGIN + np.arange(1, order, dtype=np.uint64))


def _grams(words: np.ndarray, hashes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order``, the hash of the n-gram that ends at each word; where a text begins, with its begin."""
    out, begins = [hashes[words]], _begins(order)
    for k in range(2, order + 1):
        before = np.empty_like(out[-1])
        before[1:] = out[-1][:-1]
        before[starts] = begins[k - 2]
        out.append(_mix(before * np.uint64(3) + out[0] + np.uint64(k)))
    return out


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype="<u8", count=len(words))


class _Texts:
    """A chunk's words, one text after the other, each with its end."""

    def __init__(self, row: dict, order: int) -> None:
        self.order, self.ids, self.held = order, row["docs"], np.frombuffer(row["held"], dtype=np.bool_)
        self.n = np.frombuffer(row["n"], dtype="<i8")
        self.words, self.hashes = np.frombuffer(row["words"], dtype="<i4"), _hashes(row["terms"])
        self.starts = np.cumsum(self.n) - self.n
        every = _grams(self.words, self.hashes, self.starts, order)[1:]
        #: The distinct n-grams of two words and more, and which one each word ends, for each length; begins of texts come last.
        self.grams, of = np.unique(np.concatenate([*every, _begins(order)[1:]]), return_inverse=True)
        self.of = [of[i * len(self.words): (i + 1) * len(self.words)] for i in range(order - 1)]
        self.begins = of[(order - 1) * len(self.words):]

    def learned(self) -> np.ndarray:
        """How often each n-gram was in texts that are learned from."""
        learned = np.repeat(~self.held, self.n)
        counts = np.zeros(len(self.grams), dtype=np.int64)
        for of in self.of:
            counts += np.bincount(of[learned], minlength=len(self.grams))
        counts[self.begins] += int((~self.held).sum())
        return counts


def _chunk_rows(chunk: Chunk, schema: pa.Schema) -> pa.RecordBatch:
    """The chunk's texts, and its vocabulary with the counts of what is learned from."""
    meta = chunk.table()
    held = meta.column("held_out").to_numpy()
    n = chunk.lengths()
    ends = np.cumsum(n + 1) - 1
    words = np.zeros(int(n.sum()) + len(n), dtype="<i4")
    rest = np.ones(len(words), dtype=bool)
    rest[ends] = False
    words[rest] = np.concatenate(chunk.words) + 1 if len(n) else 0
    vocabulary = [_END, *chunk.codes]
    learned = np.bincount(words[np.repeat(~held, n + 1)], minlength=len(vocabulary)).astype("<i8")
    ids = meta.column("doc").combine_chunks()
    return pa.RecordBatch.from_arrays([
        pa.array([chunk.number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([held.astype(np.bool_).tobytes()]),
        pa.array([(n + 1).astype("<i8").tobytes()]), pa.array([words.tobytes()]),
        pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), pa.array(vocabulary, pa.binary()).cast(pa.string())), pa.array([learned.tobytes()])], schema=schema)


def deal(docs: DataFrame, spec: LmSpec, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk, kept in the shared folder."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % spec.held_out == 0
    rows = docs.select(F.col(id_col).alias("doc"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", BY_SPACE, spec.chunk_words, spec.chunk_docs):
            schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(chunk.columns[0].schema.field("doc").type)), ("held", pa.binary()), ("n", pa.binary()),
                                ("words", pa.binary()), ("terms", pa.list_(pa.string())), ("learned", pa.binary())])
            yield _chunk_rows(chunk, schema)

    return keep(rows.mapInArrow(run, f"chunk bigint, docs array<{kind}>, held binary, n binary, words binary, terms array<string>, learned binary"), "lm-chunks", "zstd")


def _by_group(to: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The groups that occur, and what is in each, in order."""
    order = np.argsort(to.astype(np.uint16) if n <= 1 << 16 else to, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=n))))
    for g in np.nonzero(np.diff(cuts))[0].tolist():
        yield g, order[cuts[g]: cuts[g + 1]]


def word_counts(dealt: DataFrame, groups: int) -> DataFrame:
    """``grp, chunk, counts, distinct``: how often the words that a chunk sent to a group, in their order, were learned in the whole
    corpus; one row of a group has the number of different words learned."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, learned = batch.column("terms")[i].values, np.frombuffer(batch.column("learned")[i].as_py(), dtype="<i8")
                parts = list(_by_group(slice_of(_hashes(terms.to_pylist()), groups), groups))
                cuts = np.cumsum([0, *(len(at) for _, at in parts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), terms.take(pa.array(np.concatenate([at for _, at in parts]))))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in parts]), pa.array([batch.column("chunk")[i].as_py()] * len(parts), pa.int64()), lists,
                                                  pa.array([learned[at].tobytes() for _, at in parts], pa.binary())], names=["grp", "chunk", "terms", "learned"])

    def add(table: pa.Table) -> pa.Table:
        lists = table.column("terms").combine_chunks()
        code = lists.flatten().dictionary_encode().indices.to_numpy()
        total = np.zeros(int(code.max(initial=-1)) + 1, dtype=np.int64)
        np.add.at(total, code, np.concatenate([np.frombuffer(x, dtype="<i8") for x in table.column("learned").to_pylist()]))
        ends = np.cumsum([len(x) for x in lists])
        found = total[code]
        distinct = [int((total > 0).sum()), *[0] * (len(lists) - 1)]
        return pa.table({"grp": table.column("grp"), "chunk": table.column("chunk"),
                         "counts": pa.array([found[a:z].tobytes() for a, z in zip([0, *ends[:-1]], ends)], pa.binary()), "distinct": pa.array(distinct, pa.int64())})

    sent = dealt.select("chunk", "terms", "learned").mapInArrow(send, "grp bigint, chunk bigint, terms array<string>, learned binary")
    return sent.groupBy("grp").applyInArrow(add, "grp bigint, chunk bigint, counts binary, distinct bigint")


def _sent(dealt: DataFrame, spec: LmSpec, slices: int, all_grams: bool) -> DataFrame:
    """``slice, chunk, grams, counts``: the distinct n-grams of each chunk by slice; without ``all_grams`` those learned from alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                texts = _Texts(row, spec.order)
                grams, counts = texts.grams, texts.learned()
                if not all_grams:
                    grams, counts = grams[counts > 0], counts[counts > 0]
                parts = list(_by_group(slice_of(grams, slices), slices))
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _ in parts], pa.int64()), pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array([_packed(grams[at]) for _, at in parts], pa.binary()),
                    pa.array([counts[at].astype("<u4").tobytes() for _, at in parts], pa.binary())], names=["slice", "chunk", "grams", "counts"])

    return dealt.select("chunk", "docs", "held", "n", "words", "terms").mapInArrow(run, "slice bigint, chunk bigint, grams binary, counts binary")


def _slice_sums(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams that each chunk sent, and the distinct ones learned with their counts."""
    sent = [_unpacked(x) for x in table.column("grams").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, dtype="<u4") for x in table.column("counts").to_pylist()])
    every = np.concatenate(sent)
    every, counts = every[counts > 0], counts[counts > 0]
    order = np.argsort(every)
    every = every[order]
    first = np.nonzero(np.diff(every, prepend=~every[:1]) != 0)[0]
    return sent, every[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)


def filter_slices(sent: DataFrame, spec: LmSpec) -> DataFrame:
    """``slice, bits``: the filter."""

    def run(table: pa.Table) -> pa.Table:
        _, grams, counts = _slice_sums(table)
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([fill(grams, counts, spec).tobytes()], pa.binary())})

    return sent.groupBy("slice").applyInArrow(run, "slice bigint, bits binary")


def _probed(sent: DataFrame, spec: LmSpec) -> DataFrame:
    """``chunk, slice, levels``: each slice is made and asked for the n-grams that chunks sent, in their order."""

    def run(table: pa.Table) -> pa.Table:
        asked, grams, counts = _slice_sums(table)
        bits = fill(grams, counts, spec)
        return pa.table({"chunk": table.column("chunk"), "slice": table.column("slice"), "levels": pa.array([probe(bits, g, spec).tobytes() for g in asked], pa.binary())})

    return sent.groupBy("slice").applyInArrow(run, "chunk bigint, slice bigint, levels binary")


def _levels(grams: np.ndarray, slices: int, answer) -> np.ndarray:
    """Levels of distinct n-grams; ``answer`` gives those of a slice."""
    out = np.zeros(len(grams), dtype=np.uint8)
    for s, at in _by_group(slice_of(grams, slices), slices):
        out[at] = answer(s, grams[at])
    return out


def _log_probabilities(t: _Texts, single: np.ndarray, c: np.ndarray, texts: int, levels: np.ndarray, spec: LmSpec) -> np.ndarray:
    """log10 of the model's probability of each word. ``single``, ``c``: probability and count of single words; ``texts``: learned from."""
    count = spec.counts()[levels]
    p, seen = single[t.words], c[t.words].astype(np.float64)
    for k in range(2, spec.order + 1):
        # How often what stands before the word was learned: a single word exactly, more of them by the filter.
        before = np.empty_like(seen)
        before[1:] = seen[:-1]
        before[t.starts] = texts if k == 2 else count[t.begins[k - 3]]
        seen = count[t.of[k - 2]]
        p = (np.minimum(seen, before) + spec.strength * p) / (before + spec.strength)
    return np.log10(p)


def score(docs: DataFrame, spec: LmSpec = LmSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    A null text is empty and has its end as its one token. A null id counts as the empty text where it is held out or not; rows
    with one id are documents of their own. Other columns are not looked at; an empty table gives an empty result.
    """
    spark, out_id = docs.sparkSession, docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    dealt = deal(docs, spec, id_col, text_col)
    size = dealt.select(F.sum(F.octet_length("words") / 4), F.sum(F.size("terms"))).first()
    tokens, terms = int(size[0] or 0), int(size[1] or 0)
    groups, slices = max(-(-terms // spec.slice_grams), 1), max(-(-(spec.order - 1) * tokens // spec.slice_grams), 1)
    known = keep(word_counts(dealt, groups), "lm-words", "zstd")
    distinct = int(known.agg(F.sum("distinct")).first()[0] or 0)
    learned, texts = _learned(dealt)
    # A count enters no more levels than it counts, so the filter has at most this many entries.
    small = spec.order * learned * spec.bits / 8 + 64 * slices <= spec.broadcast_bytes
    side = known.groupBy("chunk").agg(F.collect_list(F.struct("grp", "counts")).alias("known"))
    filters = None
    if small:
        held = filter_slices(_sent(dealt, spec, slices, False), spec).collect()
        filters = spark.sparkContext.broadcast({r["slice"]: bytes(r["bits"]) for r in held})
        side = side.withColumn("levels", F.lit(None).cast("array<struct<slice: bigint, levels: binary>>"))
    else:
        probed = _probed(_sent(dealt, spec, slices, True), spec)
        side = side.join(probed.groupBy("chunk").agg(F.collect_list(F.struct("slice", "levels")).alias("levels")), "chunk", "left")
    schema = f"doc_id {out_id}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        row = rows.slice(0, 1).to_pylist()[0]
        t = _Texts(row, spec.order)
        counts = {x["grp"]: np.frombuffer(x["counts"], dtype="<i8") for x in given.column("known")[0].as_py()}
        c = np.zeros(len(row["terms"]), dtype=np.int64)
        for g, at in _by_group(slice_of(t.hashes, groups), groups):
            c[at] = counts[g]
        if filters is None:
            stored = {x["slice"]: np.frombuffer(x["levels"], dtype=np.uint8) for x in given.column("levels")[0].as_py() or ()}

        def answer(s: int, grams: np.ndarray) -> np.ndarray:
            if filters is None:
                return stored[s]
            bits = filters.value.get(s)
            return np.zeros(len(grams), dtype=np.uint8) if bits is None else probe(np.frombuffer(bits, dtype=np.uint8), _short(grams), spec)

        levels = _levels(t.grams, slices, answer)
        single = (c + 0.1) / (learned + 0.1 * (distinct + 1))
        logs = _log_probabilities(t, single, c, texts, levels, spec)
        each = np.add.reduceat
        id_type = rows.schema.field("docs").type.value_type
        return pa.table({
            "doc_id": pa.array(t.ids, id_type), "held_out": pa.array(t.held), "n_tokens": pa.array(t.n), "n_known": pa.array(each((c[t.words] > 0).astype(np.int64), t.starts)),
            "train_tokens": pa.array(np.full(len(t.n), learned)), "base_score": pa.array(each(np.log10(single)[t.words], t.starts)), "score": pa.array(each(logs, t.starts))})

    rows = dealt.select("chunk", "docs", "held", "n", "words", "terms")
    return rows.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(run, schema)


def _learned(dealt: DataFrame) -> tuple[int, int]:
    """Words (with ends) and texts that are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = sum(int(np.frombuffer(x, dtype="<i8").sum()) for x in batch.column("learned").to_pylist())
            texts = sum(int((~np.frombuffer(x, dtype=np.bool_)).sum()) for x in batch.column("held").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([texts])], names=["words", "texts"])

    r = dealt.select("learned", "held").mapInArrow(run, "words bigint, texts bigint").agg(F.sum("words"), F.sum("texts")).first()
    return int(r[0] or 0), int(r[1] or 0)
