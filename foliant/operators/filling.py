"""Filling reviewers task by task: the work inside one chunk of tasks, and what chunks hand on to each other.

The functions of this module are sent to tasks by value, so executors need not have the package installed.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fill(codes, types, start) -> tuple[list[int], list[int], list[int]]:
    """Serial greedy filling: the reviewer of each task (-1: none), the work they had then, and all workloads at the end."""
    load = [int(x) for x in start]
    heaps: dict[int, list[tuple[int, int]]] = {}
    for i, kinds in enumerate(types):
        for t in kinds:
            heaps.setdefault(t, []).append((load[i], i))
    for heap in heaps.values():
        heapq.heapify(heap)
    who, had = [], []
    for t in codes:
        heap = heaps.get(t)
        if not heap:
            who.append(-1)
            had.append(-1)
            continue
        # An entry whose workload has changed since is put back as it is now.
        while load[heap[0][1]] != heap[0][0]:
            i = heap[0][1]
            heapq.heapreplace(heap, (load[i], i))
        now, i = heap[0]
        who.append(i)
        had.append(now)
        load[i] = now + 1
        heapq.heapreplace(heap, (now + 1, i))
    return who, had, load


def next_starts(types, starts, ends) -> list[list[int]]:
    """Better guesses of where the chunks of a family start, from where they started and ended in the last pass.

    A chunk starts where the one before ended. If that one's own start has moved since, its end moves too: reviewers who share a type
    and are level with each other form a group, and the sum that the group's start moved by is dealt evenly to its end.
    """
    out = [list(starts[0])]
    for c in range(len(starts) - 1):
        out.append(_next_start(types, out[c], starts[c], ends[c]))
    return out


def _next_start(types, new, old, ended) -> list[int]:
    """Where the chunk after one starts, which started at ``old``, is to start at ``new`` and ended at ``ended``."""
    end = [int(x) for x in ended]
    moved = [int(a) - int(b) for a, b in zip(new, old)]
    if any(moved):
        for group in _level_groups(types, end):
            each, rest = divmod(sum(moved[i] for i in group), len(group))
            for place, i in enumerate(sorted(group, key=lambda i: (end[i], i))):
                end[i] += each + (place < rest)
    return end


def _level_groups(types, load) -> list[list[int]]:
    root = list(range(len(load)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    of_type: dict[int, list[int]] = {}
    for i, kinds in enumerate(types):
        for t in kinds:
            of_type.setdefault(t, []).append(i)
    for members in of_type.values():
        members.sort(key=lambda i: load[i])
        for a, b in zip(members, members[1:]):
            if load[b] - load[a] <= 1:
                root[find(a)] = find(b)
    groups: dict[int, list[int]] = {}
    for i in range(len(load)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def hand_on(family: pd.DataFrame) -> pd.DataFrame:
    """The chunks of one family (one row for ``chunk_tasks`` tasks) with their next starts; the first row has the reviewers' types.

    Only the chunk at hand is spelled out as Python numbers.
    """
    family = family.sort_values("chunk").reset_index(drop=True)
    types = per_reviewer(family["kinds"][0], family["sizes"][0])
    old, new = family["start"], [family["start"][0]]
    for c in range(len(family) - 1):
        same = np.array_equal(new[c], old[c])
        new.append(family["end"][c] if same else np.array(_next_start(types, new[c].tolist(), old[c].tolist(), family["end"][c].tolist()), "int64"))
    return family.assign(start=new, moved=[not np.array_equal(a, b) for a, b in zip(old, new)])


def per_reviewer(kinds, sizes) -> list[tuple[int, ...]]:
    """The types of each reviewer from one list of all; equal ones are one object."""
    known: dict[tuple[int, ...], tuple[int, ...]] = {}
    flat, ends = kinds.tolist(), np.cumsum(sizes).tolist()
    cut = (tuple(flat[a:b]) for a, b in zip([0, *ends], ends))
    return [known.setdefault(t, t) for t in cut]


def end(codes: str, kinds: str, sizes: str, start: str) -> Column:
    """The workloads at the end of a chunk."""

    def run(codes: pd.Series, kinds: pd.Series, sizes: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([np.array(fill(c.tolist(), per_reviewer(k, n), s)[2], "int64") for c, k, n, s in zip(codes, kinds, sizes, start)])

    return F.pandas_udf(run, "array<bigint>")(codes, kinds, sizes, start)


def places(codes: str, kinds: str, sizes: str, start: str) -> Column:
    """The reviewer of each task of a chunk, and the work they had then."""

    def run(codes: pd.Series, kinds: pd.Series, sizes: pd.Series, start: pd.Series) -> pd.DataFrame:
        filled = (fill(c.tolist(), per_reviewer(k, n), s)[:2] for c, k, n, s in zip(codes, kinds, sizes, start))
        return pd.DataFrame([(np.array(who, "int32"), np.array(had, "int64")) for who, had in filled], columns=["who", "load"])

    return F.pandas_udf(run, "who array<int>, load array<bigint>")(codes, kinds, sizes, start)
