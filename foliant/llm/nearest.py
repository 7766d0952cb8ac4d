"""Nearest vectors by inner product: collision counting with virtual rehashing.

Largest inner product becomes smallest distance by one more component: with M the largest norm of a block, a vector v
gets sqrt(M^2 - |v|^2) and a query gets 0. Each of m random lines gives every vector of a block one number; a line's
numbers are kept as a sorted array, cut into 256 pages of equal size, and each vector knows its page on each line. A query
opens on each array a window of pages centred at its own number, and a vector collides with it on each line where it
lies in the window. All windows are widened together, step by step: the hash is never made again, only the window grows
(virtual rehashing). Vectors that collide on enough lines are verified by their exact inner product. A query stops when
enough were verified: a share of the block and at least a few hundred.

Rows and queries are dealt to blocks of a bounded number of rows; each pair of blocks is one group, and the best of each group
meet in a ranking per query. No table of vectors is sent to the driver or to all executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import keep


PAGES = 256


@dataclass(frozen=True)
class NearestSpec:
    k: int = 20
    #: A row is a query if its id is divisible by this.
    every: int = 20
    lines: int = 128
    #: Collisions on so many lines make a candidate.
    threshold: int = 96
    #: Share of a block's rows to verify before a query stops, and the least number.
    share: float = 0.06
    least: int = 512
    #: First half-width of a window, in standard deviations of a line's numbers, and the factor of a widening.
    first: float = 0.6
    widen: float = 1.12
    block_rows: int = 16_384
    block_queries: int = 1_024
    seed: int = 11


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v, dim`` of the vectors that take part: not null, not zero, all components there and finite."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, spec: NearestSpec) -> list[tuple[int, int, float]]:
    """The best of one block for each query: (query, row, score)."""
    n, dim = x.shape
    norm = np.sqrt((x * x).sum(axis=1))
    top = norm.max()
    longer = np.column_stack((x, np.sqrt(np.maximum(top * top - norm * norm, 0.0))))
    lines = np.random.Generator(np.random.PCG64(spec.seed)).standard_normal((dim + 1, spec.lines))
    on_line = longer @ lines
    pages = np.empty((spec.lines, n), dtype=np.uint8)
    edges = np.empty((spec.lines, PAGES - 1))  # the number with which each page but the first begins
    for i in range(spec.lines):
        order = np.argsort(on_line[:, i], kind="stable")
        pages[i, order] = np.arange(n) * PAGES // n
        edges[i] = on_line[order[np.minimum(-(-np.arange(1, PAGES) * n // PAGES), n - 1)], i]
    unit = on_line.std(axis=0).max() or 1.0
    # A query's length does not change its ranking; at the length of the block's vectors the distances spread most.
    scale = top / np.sqrt((q * q).sum(axis=1))
    centre = (np.column_stack((q, np.zeros(len(q)))) @ lines) * scale[:, None]
    want = min(n, max(spec.k + 1, spec.least, int(spec.share * n)))
    out, last = [], 0.0
    for j in np.argsort(q_ids, kind="stable"):
        half = max(spec.first * unit, last / spec.widen)
        while True:
            lo = (edges < (centre[j] - half)[:, None]).sum(axis=1).astype(np.uint8)
            hi = (edges <= (centre[j] + half)[:, None]).sum(axis=1).astype(np.uint8)
            inside = (pages - lo[:, None]) <= (hi - lo)[:, None]  # pages below the window wrap round to large numbers
            counts = inside.view(np.uint8).sum(axis=0, dtype=np.uint8)
            found = np.nonzero(counts >= spec.threshold)[0]
            if len(found) >= want or int((hi - lo).min()) == PAGES - 1:
                break
            half *= spec.widen
        last = half  # the next query of the block starts a little below
        found = found[ids[found] != q_ids[j]]
        rough = x[found] @ q[j]
        if len(found) > spec.k:  # sums in another order differ in the last digits only
            least = np.partition(rough, -spec.k)[-spec.k]
            found = found[rough >= least - 1e-9 * max(1.0, abs(least))]
        score = np.zeros(len(found))
        for d in range(dim):  # from the first component to the last, in double precision
            score += x[found, d] * q[j, d]
        best = np.lexsort((ids[found], -score))[: spec.k]
        out += [(int(q_ids[j]), int(ids[found[b]]), float(score[b])) for b in best]
    return out


def nearest(vectors: DataFrame, spec: NearestSpec = NearestSpec(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest vectors of each query, nearest first, ties to the smaller id.

    A vector that is null, zero, or has a null or non-finite component takes no part, nor does one with a null id or one of another
    length than the query. An id that is there several times is one query, with its shortest and then least vector. Rows with the
    query's own id are no candidates; other rows that are there twice are two candidates.
    Other columns of the input are not looked at; an empty table gives an empty result.
    """
    if not 0 < spec.threshold <= spec.lines <= 255:
        raise ValueError("collisions are counted in bytes: threshold <= lines <= 255")
    rows = keep(valid(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    blocks, parts = -(-n // spec.block_rows) or 1, -(-(n // spec.every + 1) // spec.block_queries)
    side = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    data = rows.select("vec_id", "v", "dim", side.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    # One query per id, however often it is there: the shortest vector with it, then the least.
    once = rows.where(F.col("vec_id") % spec.every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q"))
    asked = once.select(
        "vec_id", "q.v", "q.dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (ids, x), (q_ids, q) = ((t.column("vec_id").to_numpy(), np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)) for t in (left, right))
            found = search_block(ids, x, q_ids, q, spec)
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    key = ["dim", "block", "part"]
    best = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")
