"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents longer than a sequence are cut; their full pieces fill a sequence each. All other pieces are items. Items of
one length can stand for each other, and so can open sequences with one gap, so both sorted sides of a round are
lists of bounded length: lengths with their number of items, gaps with their number of sequences. A round takes the largest length
that is left and

* sweeps the gaps upwards from the length: the successor of an item is the smallest gap that holds it;
* where many items want one gap, ranks decide: the first items go to the first sequences, as many to each as
  fit one after the other, the others sweep on to the next gap;
* makes the gaps that were taken smaller; items that found none open sequences.

So the result is the one of best-fit decreasing. Rounds only ever see counts per length. They yield ranges (length, ranks, first sequence,
place), and one distributed pass gives each item its rank among the items of its length and so its sequence and place.
Ranks come from counts per written partition, so no length, however common, is gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import keep
from foliant.llm.tokens import TokenizerFiles, TokenCounter


#: Texts tokenised at a time.
_TEXTS = 128


@dataclass(frozen=True)
class PackSpec:
    """``files``: the tokenizer; ``end_id`` closes each document."""

    files: TokenizerFiles = TokenizerFiles()
    size: int = 2048
    end_id: int = 0


def pieces(docs: DataFrame, spec: PackSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the pieces of each document.

    Pieces after the first are full; the first one takes what is left over, so that one piece of a document at most needs company.
    """
    size, end_id, files = spec.size, np.array([spec.end_id], dtype="<u4"), spec.files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.shared(files)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), _TEXTS):
                for k, ids in enumerate(counter.batch(batch.column("text").slice(at, _TEXTS).to_pylist()), at):
                    ids = np.concatenate((ids, end_id))
                    first = len(ids) % size or size
                    cuts = [0, *range(first, len(ids) + 1, size)]
                    rows += [(k, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            k, piece, start, length, crc = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(k)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan_rounds(counts: np.ndarray, size: int) -> np.ndarray:
    """Pack ``counts[length]`` items of each length below ``size``.

    Rows of (length, first rank, items per sequence, first sequence, place): from that rank on, until the next row of the length,
    the items go to sequences from that number on, so many to each. Sequences that were filled alike are consecutive numbers, so a
    group of them is (first, number), kept by gap.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []  # sorted
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in groups:
                insort(gaps, gap)
            groups.setdefault(gap, []).append((first, n))

    for length in np.nonzero(counts)[0][::-1].tolist():
        rank, left = 0, int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            else:
                gap, first = size, sequences
                n = -(-left // (size // length))
                sequences += n
            each = gap // length
            rows.append((length, rank, each, first, size - gap))
            whole, over = min(n, left // each), 0
            if whole < n:
                over = left - whole * each
            leave(gap - each * length, first, whole)
            if over:
                leave(gap - over * length, first + whole, 1)
            leave(gap, first + whole + bool(over), n - whole - bool(over))
            rank, left = rank + whole * each + over, left - whole * each - over
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, spec: PackSpec = PackSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is a document of one id, the closing one. Rows that are there twice are packed twice; a null id stays
    null. Other columns of the input are not looked at; an empty table gives an empty result.
    """
    items = keep(pieces(docs, spec, id_col, text_col).withColumn("part", F.spark_partition_id()), "pieces")
    per_part = keep(items.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(per_part.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "ranks")
    counts = np.zeros(spec.size + 1, dtype=np.int64)
    for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row per length
        counts[row["length"]] = row["n"]
    plan = plan_rounds(counts[: spec.size], spec.size)
    used = int(counts[: spec.size].sum())  # numbers from here on are free for full pieces
    size = spec.size
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # some rows per length and round, however many items there are

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        key = ranges[:, 0] << 48 | ranges[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            full = length == size
            at = np.maximum(np.searchsorted(key, length << 48 | rank, side="right") - 1, 0)
            if len(ranges):
                turn, each = rank - ranges[at, 1], ranges[at, 2]
                seq = np.where(full, used + rank, ranges[at, 3] + turn // each)
                offset = np.where(full, 0, ranges[at, 4] + turn % each * length)
            else:
                seq, offset = used + rank, np.zeros(len(rank), np.int64)
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = items.withColumn("r", F.row_number().over(inside)).join(starts, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("r") - 1).cast("long").alias("rank"))
    kind = items.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
