"""Shingle sets of texts as numpy arrays, for use inside tasks: a buffer of many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64, size=256, dtype=np.uint64)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _inverse(a: np.uint64) -> np.uint64:
    return np.uint64(pow(int(a), -1, 2**64))


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64-bit values.

    ``data``: the UTF-8 bytes of all texts, one after the other; ``ends``: where each ends. Returns the text number and
    the value of each distinct shingle, sorted by both. A-Z are folded; words are runs without ASCII white space; a
    text with fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if not len(data):
        return none
    data = _FOLD[data]
    space = _IS_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a text starts here
    starts = np.concatenate(([0], ends[:-1]))
    cut[starts[starts < len(data)]] = True
    before = np.concatenate(([True], space[:-1])) | cut[:-1]
    after = np.concatenate((space[1:], [True])) | cut[1:]
    first, last = np.nonzero(~space & before)[0], np.nonzero(~space & after)[0]
    if not len(first):
        return none
    # Polynomial hashes of the words from one running sum; the base is odd, so its powers can be taken back.
    sums = np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)
    back = _powers(_inverse(_BASE), len(data))
    lead = np.where(first > 0, sums[np.maximum(first - 1, 0)], np.uint64(0))
    word = mix64((sums[last] - lead) * back[first] + (last - first).astype(np.uint64))
    doc = np.searchsorted(ends, first, side="right")

    n = np.bincount(doc, minlength=len(ends))
    sums = np.cumsum(word * _powers(_STEP, len(word)), dtype=np.uint64)
    back = _powers(_inverse(_STEP), len(word))
    end_of_doc = np.cumsum(n)
    size = np.minimum(n, words)
    left = end_of_doc[doc] - np.arange(len(word))  # words from here to the end of the text
    start = np.nonzero(left >= size[doc])[0]
    upto = start + size[doc[start]] - 1
    lead = np.where(start > 0, sums[np.maximum(start - 1, 0)], np.uint64(0))
    value = mix64((sums[upto] - lead) * back[start] + size[doc[start]].astype(np.uint64))
    doc = doc[start]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))
    return doc[new], value[new]


def supermin(doc: np.ndarray, value: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures, ``docs`` x ``m``.

    Each element draws, step by step, the next place of its own random permutation and a fraction; the value at a
    place is the least (step, fraction) of any element, the step in the upper bits. Steps run over all elements together, and a text stops as
    soon as every place has a value below the next step: nothing that follows could lower one.
    """
    sig = np.full(docs * m, 0xFFFFFFFF, dtype=np.uint32)
    seed, swaps, perm = value, [], None
    shift = 32 - max((m - 1).bit_length(), 8)
    for j in range(m):
        if not len(doc):
            break
        u = mix64(seed + np.uint64((j + 1) * int(_BASE) % 2**64))
        k = (j + (u >> np.uint64(40)) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            place, moved = k.copy(), np.full(len(k), j)
            for past, to in swaps:  # the permutation so far, as the swaps that made it
                place[past == k] = to[past == k]
                moved[past == j] = to[past == j]
            swaps.append((k, moved))
        else:
            rows = np.arange(len(k))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(sig, doc * m + place, np.uint32(j << shift) | (u & np.uint64((1 << shift) - 1)).astype(np.uint32))
        seen = np.unique(doc)
        open_docs = np.zeros(docs, dtype=bool)
        open_docs[seen] = (sig.reshape(docs, m)[seen].max(axis=1) >> shift) > j
        go = open_docs[doc]
        if not go.all():
            doc, seed = doc[go], seed[go]
            swaps = [(a[go], b[go]) for a, b in swaps]
            perm = None if perm is None else perm[go]
        if perm is None and j == 5:
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(doc), 1))
            for i, (a, b) in enumerate(swaps):
                rows = np.arange(len(a))
                perm[rows, a] = b
            swaps = []
    return sig.reshape(docs, m)
