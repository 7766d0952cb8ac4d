"""Chat formatting with budgeted windows.

A conversation becomes one or more windows of text. Prefix sums of the turns' tokens choose, from the first turn on, the
longest span of whole turns that fits the budget; each later window starts with the conversation's system turn again and with as
much of the turns just before it as a part of the budget allows. A system turn of more than half the budget is shown once, where it
stands, and not again, so a window has room for at least a part of the budget that is new, and the output is a small multiple of
the input. Only the span is new: what is repeated is not trained on again, so each
assistant text is under the loss mask once. A turn longer than the budget has a window to itself and is never cut.

The template marks turns by control strings. Inside texts these are broken by a backslash after their first character, and
backslashes are doubled, so no text can end a turn, and ``read_window`` gives back every text exactly.

Turns are numbered over range partitions and a conversation is dealt to tasks in segments of a fixed number of turns, each with
the last turns before it, so a conversation of any length is never gathered in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import keep
from foliant.llm.tokens import TokenCounter, TokenizerFiles
from foliant.operators.ranking import row_numbers

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Before and after the text of each role; a role that is not here is named in its turn.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
BEGIN = "<s>"
#: Characters of turns that are tokenized together, about.
_HELD_CHARS = 2_000_000


@dataclass(frozen=True)
class ChatSpec:
    files: TokenizerFiles = TokenizerFiles()
    #: Tokens of a window, and of its repeated turns besides the system turn.
    budget: int = 1024
    history: int = 256
    #: Turns that are handled together, and how many before them are at hand to be repeated.
    segment: int = 512
    at_hand: int = 32


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its escaped text is in it."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = f"[ROLE]{escape(role)}[/ROLE]", "[END]"
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def read_window(text: str) -> list[tuple[str, str]]:
    """The role and text of each turn of a window."""
    at, turns = len(BEGIN), []
    while at < len(text):
        role = next((r for r in ("system", "user") if text.startswith(MARKS[r][0], at)), None)
        if role is None and text.startswith("[ROLE]", at):
            end = text.index("[/ROLE]", at)
            role, start, close = unescape(text[at + 6: end]), end + 7, "[END]"
        else:
            role = role or "assistant"
            start, close = at + len(MARKS[role][0]), MARKS[role][1]
        end = text.index(close, start)
        turns.append((role, unescape(text[start:end])))
        at = end + len(close)
    return turns


def _windows(turns: list[tuple], sizes: list[int], spec: ChatSpec) -> Iterator[tuple[str, int, list[dict], int]]:
    """Windows of one segment. ``turns``: (kind, number, role, and what ``format_turn`` gives), kind 0: the system turn, 1: turns before
    the segment, 2: its own; ``sizes``: their tokens.

    Yields the text, the number of repeated turns it begins with, the spans under the loss mask and the tokens.
    """
    system = [(t, n) for t, n in zip(turns, sizes) if t[0] == 0 and n <= spec.budget // 2]
    body = [(t, n) for t, n in zip(turns, sizes) if t[0] != 0]
    sums = np.concatenate(([0], np.cumsum([n for _, n in body], dtype=np.int64)))
    at = sum(t[0] == 1 for t, _ in body)
    while at < len(body):
        head = [(t, n) for t, n in system if t[1] < body[at][0][1]]
        room = spec.budget - sum(n for _, n in head)
        # As many turns before the span as their own allowance and the next turn leave.
        spare = min(spec.history, room - int(sums[at + 1] - sums[at]))
        back = int(np.searchsorted(sums, sums[at] - max(spare, 0)))
        past = [(t, n) for t, n in body[min(back, at): at] if not head or t[1] != head[0][0][1]]
        room -= sum(n for _, n in past)
        stop = max(int(np.searchsorted(sums, sums[at] + room, side="right")) - 1, at + 1)
        text, spans = BEGIN, []
        for k, (t, _) in enumerate([*head, *past, *body[at:stop]]):
            if k >= len(head) + len(past) and t[2] == "assistant":
                spans.append({"start": len(text) + t[4], "end": len(text) + t[5]})
            text += t[3]
        yield text, len(head) + len(past), spans, sum(n for _, n in [*head, *past, *body[at:stop]])
        at = stop


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a partition that is sorted by ``key``, one after the other."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        keys = list(zip(*(held.column(c).to_pylist() for c in key)))
        start = 0
        for i in range(1, len(keys)):
            if keys[i] != keys[i - 1]:
                yield keys[start], held.slice(start, i - start)
                start = i
        held = held.slice(start)
    if held is not None and held.num_rows:
        yield tuple(held.column(c)[0].as_py() for c in key), held


def _number(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns with ``conv`` (the id as text, so that null is one too), their number ``rn`` and no nulls in role and text."""
    rows = turns.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("conv"), F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return row_numbers(rows.withColumn("th", F.xxhash64("text")), ["conv"], ["turn", "role", "th"])


def format_windows(turns: DataFrame, spec: ChatSpec = ChatSpec(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: ``conv, conv_id, segment, window, text, repeated, spans, n_tokens``.

    ``repeated``: with how many turns, already in earlier windows, it begins; ``spans``: the places (code points, end exclusive) of
    what is trained on. A null text is empty, a null role is the empty role, a null conversation id is a conversation of its own.
    Turns with one number come by role, then by a hash of the text; turns that are there twice stay twice. Roles besides
    system, user and assistant are named in their turn and never trained on. Other columns of the input are not looked at; an empty
    table gives an empty result.
    """
    rows = keep(_number(turns, id_col, turn_col, role_col, text_col), "turns")
    segment = F.floor((F.col("rn") - 1) / spec.segment).cast("int")
    own = rows.select("conv", "conv_id", segment.alias("segment"), F.lit(2).alias("kind"), "rn", "role", "text")
    # The last turns of a segment are at hand for the next one, which may not exist: then there is nothing to join.
    last = own.where(F.col("rn") > (F.col("segment") + 1) * spec.segment - spec.at_hand).select("conv", "conv_id", (F.col("segment") + 1).alias("segment"), F.lit(1).alias("kind"), "rn", "role", "text")
    later = keep(own.where("segment > 0").select("conv", "segment").distinct(), "later-segments")
    last = last.join(later, ["conv", "segment"], "left_semi")
    systems = rows.where("role = 'system'").groupBy("conv").agg(F.min_by(F.struct("conv_id", "rn", "role", "text"), "rn").alias("s"))
    first = own.select("conv", "segment").where("segment = 0").distinct().union(later)
    systems = first.join(systems, "conv").select("conv", "s.conv_id", "segment", F.lit(0).alias("kind"), "s.rn", "s.role", "s.text")
    dealt = own.union(last).union(systems).repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.shared(spec.files)
        held: list[tuple] = []

        def windows() -> pa.RecordBatch:
            """The windows of what is held, whose turns are tokenized in one call."""
            sizes = iter([len(i) for i in counter.batch([t[3] for *_, turns in held for t in turns])])
            out = [{"conv": conv, "conv_id": conv_id, "segment": seg, "window": k, "text": text, "repeated": repeated, "spans": spans, "n_tokens": n}
                   for conv, conv_id, seg, turns in held for k, (text, repeated, spans, n) in enumerate(_windows(turns, [next(sizes) for _ in turns], spec))]
            held.clear()
            return pa.RecordBatch.from_pylist(out, schema)

        n_held = 0
        for (conv, seg), t in _runs(batches, ["conv", "segment"]):
            turns = [(kind, number, role, *format_turn(role, text)) for kind, number, role, text in zip(*(t.column(c).to_pylist() for c in ("kind", "rn", "role", "text")))]
            held.append((conv, t.column("conv_id")[0].as_py(), seg, turns))
            n_held += sum(len(x[3]) for x in turns)
            if n_held >= _HELD_CHARS:
                yield windows()
                n_held = 0
        if held:
            yield windows()

    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv", pa.string()), ("conv_id", pa.int64() if kind.simpleString() == "bigint" else pa.string()), ("segment", pa.int32()), ("window", pa.int32()),
                        ("text", pa.string()), ("repeated", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_tokens", pa.int64())])
    return dealt.sortWithinPartitions("conv", "segment", "kind", "rn").mapInArrow(
        run, f"conv string, conv_id {kind.simpleString()}, segment int, window int, text string, repeated int, spans array<struct<start bigint, end bigint>>, n_tokens bigint")


def digests(windows: DataFrame) -> DataFrame:
    """What the windows say when they are read back, a row per conversation.

    A digest over a whole conversation has to go through its turns in order; it is fed window by window, so nothing but
    its state is held.
    """
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        now, row = None, {}

        def close() -> None:
            if row:
                done.append({**row, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})

        turns = loss = None
        for batch in batches:
            for conv, conv_id, text, repeated, spans in zip(*(batch.column(c).to_pylist() for c in ("conv", "conv_id", "text", "repeated", "spans"))):
                if conv != now:
                    close()
                    now, turns, loss = conv, hashlib.sha256(), hashlib.sha256()
                    row = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_windows": 0}
                for role, said in read_window(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    row["n_turns"] += 1
                for s in spans:
                    learned = unescape(text[s["start"]: s["end"]])
                    loss.update(learned.encode())
                    row["loss_chars"] += len(learned)
                row["formatted_chars"] += len(text)
                row["n_windows"] += 1
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    types = [pa.int64() if kind == "bigint" else pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))
    sorted_windows = windows.repartition(n, "conv").sortWithinPartitions("conv", "segment", "window")
    return sorted_windows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")


def turn_row(conv_id: int, turn: int, role: str, text: str) -> list[Column]:
    """One row of a conversation table."""
    return [F.lit(conv_id).cast("bigint").alias("conv_id"), F.lit(turn).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text")]
