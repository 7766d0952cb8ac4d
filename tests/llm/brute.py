"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def near_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """Set size and component of each document."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
            common = len(x & y)
            if 100 * common >= 75 * (len(x) + len(y) - common):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in texts}


def base_secrets(text: str | None) -> list[str]:
    text = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x for _, _, x in sorted(found)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def conversation(turns: list[tuple[str | None, str | None]]) -> tuple[int, str, int, str]:
    """Number of turns, digest of all turns, characters and digest of what is learned."""
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(learned), sha(learned)


def full_packing(rows, ids: dict[int, list[int]], size: int) -> int:
    """Check every piece against the ids of its document and every sequence for gaps; the number of sequences."""
    import zlib

    import numpy as np

    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for i, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and (i == 0 or r.length == size)
            assert zlib.crc32(np.array(ids[doc][at:at + r.length], dtype="<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[doc]) and len(parts) == -(-at // size)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_seq)


def best_fit_decreasing(lengths: list[int], size: int) -> int:
    from bisect import bisect_left, insort

    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(gaps, x)
        gap = gaps.pop(i) if i < len(gaps) else size
        n += gap == size
        if gap > x:
            insort(gaps, gap - x)
    return n


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """Item, rank, document and score of the best documents; ``docs`` and ``items``: (id, text). A null document id comes first among equals."""
    found = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in found for w in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(FOLD)))
    out = []
    for item, terms in asked.items():
        scored = []
        for (doc, c), size in zip(found, sizes):
            m = 50 + (50 * size * n) // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in terms if w in c)
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def word_scores(docs: list[tuple]) -> list[tuple]:
    """Per document: id, held out, tokens, known ones, tokens learned from, base score."""
    words = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*WORD.findall((t or "").translate(FOLD)), ""]) for i, t in docs]
    c = Counter(w for _, held, ws in words if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, held, ws in words]


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(turns: list[tuple]) -> dict:
    """Turns of each conversation, in order, with planted faults; ``turns``: (conversation, turn, role, text)."""
    talks: dict = {}
    for conv, turn, role, text in turns:
        h = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = talks.setdefault(conv, [])
        if h:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
            rows += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1], sha(t[2]))) for c, rows in talks.items()}


def repaired(rows: list[tuple]) -> tuple:
    """Gaps, blank, duplicate, truncated, illegal, cost, audit and digest of a conversation: the least audit among the cheapest, from the end."""
    seen, kinds = set(), []
    for _, role, text in rows:
        ink = text.strip(SPACE)
        kinds.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "U", "S": "U", "U": "A", "A": "U"}
    best = {"": (0, ""), "A": (0, ""), "U": (3, "I"), "S": (6, "II")}
    for (_, role, _), kind in zip(rows[::-1], kinds[::-1]):
        now = {}
        for q, to in after.items():
            ways = [("D", 4, q)]
            if kind in ("", "truncated"):
                extra, first = 3 * (kind != ""), role[:1].upper()
                ways.append(("R", 3 + extra, to))
                if (first == "S" and q == "") or first == to:
                    ways.append(("K", extra, first))
            now[q] = min((cost + best[s][0], edit + best[s][1]) for edit, cost, s in ways)
        for _ in range(3):
            now = {q: min(x, (now[after[q]][0] + 3, "I" + now[after[q]][1])) for q, x in now.items()}
        best = now
    cost, audit = best[""]
    out, q, left = [], "", list(rows)
    for edit in audit:
        _, role, text = left.pop(0) if edit != "I" else (None, None, "")
        if edit != "D":
            q = role[0].upper() if edit == "K" else after[q]
            out.append((role if edit == "K" else {"U": "user", "A": "assistant"}[q]) + ":" + text)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(out)))
