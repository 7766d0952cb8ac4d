"""What the chunks of shared reviewers hand on to each other."""

import tracemalloc

import numpy as np
import pandas as pd

from foliant.operators import filling


def family(reviewers, chunks):
    rng = np.random.default_rng(5)
    starts = [rng.integers(0, 9, reviewers) for _ in range(chunks)]
    kinds = np.array([k % 5 for i in range(reviewers) for k in (i, i + 1)], "int32")
    first = [True, *[False] * (chunks - 1)]
    return pd.DataFrame({"family": "f", "chunk": range(chunks), "kinds": [kinds if f else None for f in first], "start": starts, "end": [s + 1 for s in starts],
                         "sizes": [np.full(reviewers, 2, "int32") if f else None for f in first]})


def test_hand_on_equals_the_lists():
    df = family(40, 12)
    types = filling.per_reviewer(df["kinds"][0], df["sizes"][0])
    assert types[:2] == [(0, 1), (1, 2)] and types[0] is types[5]
    want = filling.next_starts(types, [s.tolist() for s in df["start"]], [e.tolist() for e in df["end"]])
    got = filling.hand_on(df.sample(frac=1, random_state=1))
    assert [s.tolist() for s in got["start"]] == want
    assert got["moved"].tolist() == [a != b.tolist() for a, b in zip(want, df["start"])]


def test_hand_on_spells_out_one_chunk_at_a_time():
    df = family(1000, 300)
    tracemalloc.start()
    filling.hand_on(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 8 * 1000 * 300
