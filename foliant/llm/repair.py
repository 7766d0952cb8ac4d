"""Conversation structure repair: rank-convergence parallel Viterbi.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in alternation, ending with an
assistant. Each turn is kept, given another role or deleted, and empty turns are inserted; each edit has a cost. The cheapest edits
are a shortest path through the stages of a Viterbi trellis whose states say what the conversation ended with so far: nothing,
system, user, assistant.

Costs to the end are computed backwards. A conversation is dealt to chunks of a bounded number of turns, all of which start
at once from a speculative vector of costs at their right end (the last one from the true one). Then fix-up passes follow:
chunks run again from the vectors that chunks came to, beside their old run, until the two vectors differ only by a
constant: from there on all choices are the same, and so is what is left of the chunk, up to that constant. Passes are rerun until
no chunk comes to another vector; nearly all runs converge within a few turns. Which vector each chunk starts from is then stitched
together from right to left, in groups of a bounded number of chunks.

Then every chunk traces the least audit among the cheapest edits from each state that it could be entered in, and the
maps from entry to exit are stitched in the same way. In a state each kind of edit leads to one
next state, so an audit is a path, and the least letter at each step gives the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import keep
from foliant.operators.ranking import row_numbers

#: States: nothing, system, user, assistant. The state after the user or assistant turn that may come next, and its role.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE = ("", "", "user", "assistant")
#: A turn is a letter: the initial of its role (other ones are o), or its capital where it ends cut off; x must be deleted.
LETTERS = "suaoSUAOx"
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


@dataclass(frozen=True)
class RepairSpec:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    #: What a turn that ends cut off costs if it stays.
    cut_off: int = 3
    #: Turns of a chunk, and chunks whose maps are composed together.
    chunk: int = 256
    fan: int = 256

    @property
    def end(self) -> tuple[int, ...]:
        """Costs after the last turn."""
        return 0, 2 * self.insert, self.insert, 0


def _edges(spec: RepairSpec) -> tuple[np.ndarray, np.ndarray]:
    """For each letter and state: the cost of keeping (without bound where it is not allowed) and of another role."""
    keep_cost, role_cost = np.full((len(LETTERS), 4), 1 << 40), np.full((len(LETTERS), 4), 1 << 40)
    for i, letter in enumerate(LETTERS[:-1]):
        extra = spec.cut_off if letter.isupper() else 0
        role_cost[i] = spec.rerole + extra
        state = _INITIAL.get(letter.lower())
        for q in range(4):
            if (state == SYSTEM and q == NOTHING) or state == NEXT[q]:
                keep_cost[i, q] = extra
    return keep_cost, role_cost


def _kept_state(letter: str) -> int:
    return _INITIAL.get(letter.lower(), NOTHING)


class _Trellis:
    def __init__(self, spec: RepairSpec) -> None:
        self.spec, (self.keep, self.role) = spec, _edges(spec)
        self.into = np.array([_kept_state(c) for c in LETTERS])

    def step(self, letters: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Costs before a turn for each row, from those after it."""
        kept = self.keep[letters] + np.take_along_axis(after, self.into[letters][:, None], axis=1)
        now = np.minimum(np.minimum(kept, self.role[letters] + after[:, NEXT]), after + self.spec.delete)
        user, assistant = now[:, USER].copy(), now[:, ASSISTANT].copy()
        now[:, USER] = np.minimum(user, assistant + self.spec.insert)
        now[:, ASSISTANT] = np.minimum(assistant, user + self.spec.insert)
        now[:, :USER] = np.minimum(now[:, :USER], now[:, [USER]] + self.spec.insert)
        return now

    def back(self, turns: np.ndarray, lengths: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Costs at the left ends of chunks (rows of letters), least 0, from those at the right ends."""
        now = right.copy()
        for at in range(turns.shape[1] - 1, -1, -1):
            here = np.nonzero(lengths > at)[0]
            now[here] = level(self.step(turns[here, at], now[here]))
        return now

    def fix_up(self, turns: np.ndarray, lengths: np.ndarray, old: np.ndarray, new: np.ndarray, left: np.ndarray) -> np.ndarray:
        """What ``left`` becomes with ``new`` in place of ``old`` at the right ends; a row stops where both runs differ by a constant."""
        old, new, left = old.copy(), new.copy(), left.copy()
        open_ = np.ones(len(turns), dtype=bool)
        for at in range(turns.shape[1] - 1, -1, -1):
            here = np.nonzero(open_ & (lengths > at))[0]
            if not len(here):
                continue
            old[here], new[here] = level(self.step(turns[here, at], old[here])), level(self.step(turns[here, at], new[here]))
            open_[here[(old[here] == new[here]).all(axis=1)]] = False
        left[open_] = new[open_]
        return left

    def trace(self, letters: str, right: list[int], last: bool) -> list[tuple[int, int, str]]:
        """For each state to enter in: the exit state, the cost and the least audit of the cheapest edits."""
        codes = np.array([LETTERS.index(c) for c in letters])
        costs = np.empty((len(codes) + 1, 4), dtype=np.int64)
        costs[-1] = right
        for i in range(len(codes) - 1, -1, -1):
            costs[i] = self.step(codes[i: i + 1], costs[i + 1: i + 2])[0]
        spec, out = self.spec, []
        to, keep_cost, role_cost, table = NEXT.tolist(), self.keep.tolist(), self.role.tolist(), costs.tolist()
        for entry in range(4):
            q, i, paid, audit = entry, 0, 0, []
            while i < len(codes) or (last and q not in (NOTHING, ASSISTANT)):
                here = table[i][q]
                if i < len(codes) and spec.delete + table[i + 1][q] == here:
                    edit, cost, q, i = "D", spec.delete, q, i + 1
                elif spec.insert + table[i][to[q]] == here:
                    edit, cost, q = "I", spec.insert, to[q]
                elif keep_cost[codes[i]][q] + table[i + 1][self.into[codes[i]]] == here:
                    edit, cost, q, i = "K", keep_cost[codes[i]][q], int(self.into[codes[i]]), i + 1
                else:
                    edit, cost, q, i = "R", role_cost[codes[i]][q], to[q], i + 1
                paid += cost
                audit.append(edit)
            out.append((q, paid, "".join(audit)))
        return out


def level(costs: np.ndarray) -> np.ndarray:
    """Vectors that differ by a constant become equal."""
    return costs - costs.min(axis=1, keepdims=True)


def _matrix(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers, a row for each chunk, and the rows' lengths."""
    lengths = np.array([len(x) for x in letters], dtype=np.int64)
    out = np.zeros((len(letters), int(lengths.max(initial=0))), dtype=np.int64)
    known = np.zeros(128, dtype=np.int64)
    known[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    for i, x in enumerate(letters):
        out[i, : len(x)] = known[np.frombuffer(x.encode(), dtype=np.uint8)]
    return out, lengths


#: Letter of a turn from its role and faults.
def _letter(role: Column, deleted: Column, cut_off: Column) -> Column:
    first = F.substring(role, 1, 1)
    plain = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(deleted, "x").when(cut_off, F.upper(plain)).otherwise(plain)


def _numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, rn, turn, role, text, blank, duplicate, truncated``: the first fault of each turn, in a kept table.

    ``conv`` is the id as text (so that null is one too). Turns come by number, null first, then by role and a hash of the text.
    """
    text, role = F.coalesce(F.col(text_col), F.lit(" ")), F.coalesce(F.col(role_col), F.lit(" "))
    rows = turns.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("null")).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    ink = F.regexp_extract(F.col("text"), r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = keep(rows.withColumns({"th": F.sha2(F.col("text"), 256), "ink": ink, "row": F.monotonically_increasing_id()}), "repair-turns")
    slim = row_numbers(rows.drop("text"), ["conv"], ["turn", "role", "th", "row"])
    slim = keep(slim.select("row", "conv", "rn", "turn", "role", "th", "ink"), "repair-numbers")
    # Unique pairs, so that a text which is there very often is one row to join.
    first = slim.groupBy("conv", "role", "th").agg(F.min("rn").alias("rn")).select("conv", "rn", F.lit(True).alias("first"))
    faults = slim.join(first, ["conv", "rn"], "left").select("row", "conv", "rn", "turn", "role", (F.col("ink") == "").alias("blank"),
                                                             ((F.col("ink") != "") & F.col("first").isNull()).alias("duplicate"),
                                                             ((F.col("ink") != "") & F.col("first").isNotNull() & ~F.col("ink").isin(".", "!", "?")).alias("truncated"))
    return keep(faults.join(rows.select("row", "text"), "row").drop("row"), "repair-faults")


def _chunks(faults: DataFrame, spec: RepairSpec) -> DataFrame:
    """``conv, chunk, letters, illegal, end``: the turns of a chunk as letters, how many follow a turn that they may not follow, and
    the number of the conversation's last chunk."""
    number = F.floor((F.col("rn") - 1) / spec.chunk)
    letter = _letter(F.col("role"), F.col("blank") | F.col("duplicate"), F.col("truncated"))
    first = F.substring("role", 1, 1)
    rows = faults.select("conv", "rn", number.alias("chunk"), letter.alias("letter"), F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"))
    own = rows.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("rn", "letter", "initial"))).alias("t"))
    own = own.select("conv", "chunk", F.array_join("t.letter", "").alias("letters"), F.array_join("t.initial", "").alias("initials"))
    # The initial before each chunk, which may not exist.
    before = rows.where(F.col("rn") % spec.chunk == 0).select("conv", (F.col("chunk") + 1).alias("chunk"), F.col("initial").alias("before"))
    ends = rows.groupBy("conv").agg(F.max("chunk").alias("end"))
    joined = own.join(before, ["conv", "chunk"], "left").join(ends, "conv")
    line = F.concat(F.coalesce("before", F.lit("")), "initials")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("line") - 1, F.lit(1))), lambda i: F.substring(F.col("line"), i, F.lit(2)))
    wrong = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    joined = joined.withColumn("line", line).withColumn("illegal", wrong.cast("long"))
    return keep(joined.select("conv", "chunk", "letters", "illegal", "end"), "repair-chunks")


_VECTOR = pa.list_(pa.int64())
_RUNS = "conv string, chunk bigint, letters string, lefts array<array<bigint>>"


def _speculate(rows: DataFrame, spec: RepairSpec) -> DataFrame:
    """``lefts``: the costs found at the left end from the assumed ones at the right end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trellis = _Trellis(spec)
        for batch in batches:
            turns, lengths = _matrix(batch.column("letters").to_pylist())
            left = trellis.back(turns, lengths, np.tile(level(np.array([spec.end])), (len(turns), 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[x] for x in left.tolist()], pa.list_(_VECTOR))], names=["conv", "chunk", "letters", "lefts"])

    return rows.select("conv", "chunk", "letters").mapInArrow(run, _RUNS)


def _fixed_up(rows: DataFrame, vectors: list[list[int]], fresh: list[list[int]], spec: RepairSpec) -> DataFrame:
    """Append to ``lefts`` what each of the ``fresh`` vectors at the right end leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trellis = _Trellis(spec)
        for batch in batches:
            turns, lengths = _matrix(batch.column("letters").to_pylist())
            lefts = batch.column("lefts").to_pylist()
            old, left = np.tile(np.array(vectors[:1]), (len(turns), 1)), np.array([x[0] for x in lefts]).reshape(-1, 4)
            for vector in fresh:
                for x, found in zip(lefts, trellis.fix_up(turns, lengths, old, np.tile(np.array([vector]), (len(turns), 1)), left).tolist()):
                    x.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), batch.column("letters"), pa.array(lefts, pa.list_(_VECTOR))],
                                             names=["conv", "chunk", "letters", "lefts"])

    return rows.mapInArrow(run, _RUNS)


def boundaries(chunks: DataFrame, spec: RepairSpec) -> tuple[DataFrame, int]:
    """``conv, chunk, right``: the costs at the right end of each chunk, up to a constant, and the number of fix-up passes.

    Turns that are all alike can hand a difference on without end, so a pass does not go from neighbour to neighbour: it runs
    every chunk from all vectors that any chunk newly came to. There are few, because edits connect the states and so bound the
    differences; when none is new, the maps from right to left vectors are composed.
    """
    first = level(np.array([spec.end])).tolist()
    several = keep(chunks.where("end > 0"), "repair-several")
    alone = chunks.where("end = 0").select("conv", "chunk", F.lit(0).alias("entry"))
    vectors, passes = [*first], 0
    entries = alone
    if not several.isEmpty():
        runs = keep(_speculate(several, spec), "repair-pass-0")
        while True:
            found = sorted(list(r["v"]) for r in runs.select(F.explode("lefts").alias("v")).distinct().collect())
            fresh = [v for v in found if v not in vectors]
            if not fresh:
                break
            passes += 1
            runs = keep(_fixed_up(runs, vectors, fresh, spec), f"repair-pass-{passes}")
            vectors += fresh
        known = F.array(*(F.array(*(F.lit(x).cast("bigint") for x in v)) for v in vectors))
        ids = F.transform("lefts", lambda v: (F.array_position(known, v) - 1).cast("int"))
        back = runs.join(several.select("conv", "chunk", "end"), ["conv", "chunk"]).select("conv", "end", (F.col("end") - F.col("chunk")).alias("chunk"), ids.alias("exits"))
        ends = several.select("conv", "end").distinct()
        entries = alone.unionByName(_entries(back.drop("end"), spec, len(vectors)).join(ends, "conv").select("conv", (F.col("end") - F.col("chunk")).alias("chunk"), "entry"))
    rights = F.array(*(F.array(*(F.lit(x).cast("bigint") for x in v)) for v in vectors))
    return entries.select("conv", "chunk", F.get(rights, F.col("entry")).alias("right")), passes


def _maps(chunks: DataFrame, right: DataFrame, spec: RepairSpec) -> DataFrame:
    """``conv, chunk, exits, costs, audits``: by the state that a chunk is entered in."""
    schema = pa.schema([("conv", pa.string()), ("chunk", pa.int64()), ("exits", pa.list_(pa.int32())), ("costs", _VECTOR), ("audits", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trellis, seen = _Trellis(spec), {}
        for batch in batches:
            found = []
            for letters, costs, last in zip(*(batch.column(c).to_pylist() for c in ("letters", "right", "last"))):
                key = (letters, tuple(costs), last)
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[key] = trellis.trace(letters, costs, last)
                found.append(seen[key])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk").cast(pa.int64()),
                                              *(pa.array([[x[i] for x in f] for f in found], schema.field(i + 2).type) for i in range(3))], schema=schema)

    rows = chunks.join(right, ["conv", "chunk"]).select("conv", "chunk", "letters", "right", (F.col("chunk") == F.col("end")).alias("last"))
    return keep(rows.mapInArrow(run, "conv string, chunk bigint, exits array<int>, costs array<bigint>, audits array<string>"), "repair-maps")


def _entries(maps: DataFrame, spec: RepairSpec, width: int = 4) -> DataFrame:
    """``conv, chunk, entry``: what each chunk is entered with, where chunk 0 is entered with 0 and ``exits`` says for each of
    ``width`` entries what the next chunk is entered with. Maps of neighbours are composed level by level, then entries go down."""
    levels = [maps.select("conv", "chunk", "exits")]
    while not levels[-1].where("chunk > 0").isEmpty():
        group = levels[-1].groupBy("conv", F.floor(F.col("chunk") / spec.fan).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("chunk", "exits"))).alias("m"))
        through = F.transform(F.array(*[F.lit(q) for q in range(width)]), lambda q: F.aggregate("m", q, lambda s, m: F.get(m["exits"], s)))
        levels.append(keep(group.select("conv", "chunk", through.alias("exits")), f"repair-level-{len(levels)}"))
    entries = levels[-1].select("conv", "chunk", F.lit(0).alias("entry"))
    for below in reversed(levels[:-1]):
        group = below.groupBy("conv", F.floor(F.col("chunk") / spec.fan).alias("up")).agg(F.sort_array(F.collect_list(F.struct("chunk", "exits"))).alias("m"))
        known = group.join(entries.select("conv", F.col("chunk").alias("up"), "entry"), ["conv", "up"])
        states = F.aggregate("m", F.array("entry"), lambda s, m: F.array_append(s, F.get(m["exits"], F.element_at(s, -1))))
        entries = known.select("conv", F.explode(F.arrays_zip(F.col("m.chunk").alias("chunk"), F.slice(states, 1, F.size("m")).alias("entry"))).alias("e")).select("conv", "e.chunk", "e.entry")
    return entries


@dataclass(frozen=True)
class Repaired:
    """``turns``: the repaired turns ``conv, chunk, place, role, text, edit``; ``chunks``: per chunk ``conv, chunk, cost, audit, illegal``;
    ``faults``: the numbered turns; ``passes``: fix-up passes."""

    turns: DataFrame
    chunks: DataFrame
    faults: DataFrame
    passes: int


def repair(turns: DataFrame, spec: RepairSpec = RepairSpec(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """The cheapest repair of each conversation.

    A null role or text is one space; a null conversation id is a conversation of its own (``conv`` is the id as text). Turns come by
    number, null first, equal ones by role and text; turns that are there twice are duplicates. Other columns are not looked at; empty
    tables give empty results.
    """
    faults = _numbered(turns, conv_col, turn_col, role_col, text_col)
    chunks = _chunks(faults, spec)
    right, passes = boundaries(chunks, spec)
    maps = _maps(chunks, right, spec)
    at = F.col("entry") + 1
    chosen = maps.join(_entries(maps, spec), ["conv", "chunk"]).select(
        "conv", "chunk", "entry", F.element_at("costs", at).alias("cost"), F.element_at("audits", at).alias("audit"))
    chosen = keep(chosen.join(chunks.select("conv", "chunk", "illegal"), ["conv", "chunk"]), "repair-chosen")
    # The edits of a chunk, the turn that each one takes, and the role it gives: after an optional system turn they alternate.
    edits = chosen.where("audit <> ''").select("conv", "chunk", "entry", F.posexplode(F.split("audit", "")).alias("place", "edit"), "audit")
    upto = F.substring(F.col("audit"), F.lit(1), F.col("place") + 1)
    taken = F.length(F.translate(upto, "I", ""))
    edits = edits.where("edit <> 'D'").select("conv", "chunk", "place", "edit", F.when(F.col("edit") != "I", F.col("chunk") * spec.chunk + taken).alias("rn"),
                                              F.length(F.translate(upto, "D", "")).alias("nth"), "entry")
    said = edits.where("rn is not null").join(faults.select("conv", "rn", "role", "text"), ["conv", "rn"])
    rows = said.unionByName(edits.where("rn is null").withColumns({"role": F.lit(None).cast("string"), "text": F.lit("")}))
    # A chunk entered with nothing may begin with a system turn that is kept, which moves the alternation by one.
    headed = rows.where((F.col("entry") == NOTHING) & (F.col("nth") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s")).select("conv", "chunk", F.lit(1).alias("head"))
    rows = rows.join(headed, ["conv", "chunk"], "left")
    before = F.when(F.col("entry") == USER, 1).otherwise(F.lit(0)) - F.coalesce("head", F.lit(0))
    given = F.when((F.col("nth") + before) % 2 == 1, "user").otherwise("assistant")
    rows = rows.withColumn("role", F.when(F.col("edit") == "K", F.col("role")).otherwise(given))
    return Repaired(rows.select("conv", "chunk", "place", "role", "text", "edit"), chosen.drop("entry"), faults, passes)


def damage(turns: DataFrame) -> DataFrame:
    """Faults planted by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0 the turn goes, 1 its text is emptied, 2 loses its
    ``.!?``, 3 the turn is there twice, 4 its role becomes user."""
    space = F.lit(" ")
    number = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = turns.select("conv_id", "turn", F.when(number == 4, "user").otherwise(role).alias("role"),
                        F.when(number == 1, "").when(number == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), number.alias("h"))
    return rows.where("h <> 0").withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("h", "copy")


def _digest(turns: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` of the repaired turns; a conversation goes through one task in order, which holds the digest's state only."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if conv != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], names=["conv", "repaired_sha256"])
                done.clear()
        if now is not None:
            done.append((now, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], names=["conv", "repaired_sha256"])

    return turns.select("conv", "chunk", "place", "role", "text").repartition(n, "conv").sortWithinPartitions("conv", "chunk", "place").mapInArrow(
        run, "conv string, repaired_sha256 string")


def report(original: DataFrame, repaired: Repaired, conv_col: str = "conv_id") -> DataFrame:
    """A row per conversation of ``original``: what was wrong with it, the cheapest edits and a digest of the repaired turns.

    A conversation without turns has zeros, an empty audit and the digest of the empty text.
    """
    turns = repaired.faults.groupBy("conv", "turn").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")))
    found = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    edits = repaired.chunks.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
                                                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    ids = original.select(F.col(conv_col)).distinct().withColumn("conv", F.coalesce(F.col(conv_col).cast("string"), F.lit("null")))
    rows = ids.join(found, "conv", "left").join(edits, "conv", "left").join(_digest(repaired.turns), "conv", "left")
    return rows.select(conv_col, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
