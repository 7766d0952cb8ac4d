"""Ranked search, language-model scores and conversation repair: whole queries and hand-made tables against plain versions."""

import random
from dataclasses import replace

import duckdb
import pytest

from foliant.llm import queries as q
from foliant.llm.bloom_lm import LmSpec, fill, probe, score
from foliant.llm.lexical import LexicalSpec, build_index, search
from foliant.llm.repair import RepairSpec, damage, repair, report
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, item_id string, score string"


def rows_of(table, columns):
    return duckdb.sql(f"select {columns} from '{SF_DIR}/{table}.parquet'").fetchall()


def odd_texts(seed, n):
    """Nulls, empty texts, repeated rows and ids, very common and very long texts."""
    rng = random.Random(seed)
    words = ["the", "The", "a1", "é", "Ünï", "x-y", "😀", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 40])))) for i in range(n)]
    return [*rows, (None, "the w1 w2"), (None, "the w1 w2"), (5, "the w1 w2"), (7, rows[7][1]), (900, None), (901, ""), (902, " .,-\n"), (903, "the " * 5000 + "w3")]


@pytest.mark.parametrize("spec", [LexicalSpec(k=7, shard_docs=16, block=4, window=8, query_block=3, cached=2), LexicalSpec(k=7)])
def test_search_equals_brute_force(spark, spec):
    docs = odd_texts(1, 150)
    items = [(1, "The w1, w2 w3"), (2, "w1"), (2, "w5 w6"), (3, None), (4, "absent"), (None, "é the"), (6, "the"), (7, " ".join(f"w{i}" for i in range(60))), (8, "")]
    index = build_index(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(3), spec)
    got = search(index, spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string"), spec).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert order(map(tuple, got)) == order(brute.ranked(docs, items, spec.k))


def test_search_skips_blocks(spark):
    """A rare term decides, so blocks of the common one stay packed."""
    from foliant.llm import lexical

    docs = spark.createDataFrame([(i, ("rare " if i < 60 else "") + "common " + f"x{i}") for i in range(4000)], "doc_id long, text string").coalesce(1)
    spec = LexicalSpec(k=5, block=16, window=64)
    rows = build_index(docs, spec).where("term in ('rare', 'common')").orderBy("term").collect()
    import numpy as np

    lists = [lexical._List(np.frombuffer(r["last"], "<u4").astype(np.int64), np.array([lexical.part(np.array([1]), np.array([2]), (4000, 12000))[0]] * len(r["blocks"])), list(r["blocks"])) for r in rows]
    opened = set()

    class Counting(lexical._Shard):
        def postings(self, i, b):
            opened.add((i, b))
            return super().postings(i, b)

    Counting(lists, (4000, 12000), spec).search([(0, 1), (1, 5000)])
    assert {b for i, b in opened if i == 0} <= set(range(8))


def test_search_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(build_index(empty), items).collect() == []
    full = build_index(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert search(full, items.limit(0)).collect() == []


def test_lm_query(spark):
    got = {r.doc_id: r for r in q.op12_lm_scores(spark, SF_DIR).collect()}
    base = brute.word_scores(rows_of("documents", "doc_id, text"))
    assert len(got) == len(base)
    for i, held, n, known, learned, log in base:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, learned) and r.base_score == pytest.approx(log, abs=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert all(r.score < 0 for r in got.values()) and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edges_and_both_ways_of_probing(spark):
    docs = odd_texts(2, 120)
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(3)
    spec = LmSpec(order=3, chunk_docs=20, slice_grams=500)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    near = sorted((tuple(r) for r in score(frame, spec).collect()), key=key)
    far = sorted((tuple(r) for r in score(frame, replace(spec, broadcast_bytes=0)).collect()), key=key)
    assert near == far
    want = sorted(brute.word_scores(docs), key=key)
    assert [r[:5] for r in near] == [r[:5] for r in want] and [r[5] for r in near] == pytest.approx([r[5] for r in want])
    assert score(frame.limit(0), spec).collect() == []


def test_lm_is_the_smoothed_estimate(spark):
    """With an error rate of next to nothing, scores are those of exact quantised counts."""
    import math
    import zlib
    from collections import Counter

    docs = odd_texts(3, 60)
    spec = LmSpec(hashes=40, chunk_docs=15)
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 6)) for r in score(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spec).collect())
    least, count = spec.levels(), spec.counts()
    texts = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*brute.WORD.findall((t or "").translate(brute.FOLD)), ""]) for i, t in docs]
    one, two = Counter(), Counter()
    for _, held, ws in texts:
        if not held:
            one.update([None, *ws])
            two.update(zip([None, *ws], ws))
    n, v = sum(one.values()) - one[None], len(one) - 1
    value = lambda c: count[sum(c >= least)]
    want = Counter()
    for i, _, ws in texts:
        log = 0.0
        for h, w in zip([None, *ws], ws):
            p = (one[w] + 0.1) / (n + 0.1 * (v + 1))
            log += math.log10((min(value(two[h, w]), one[h]) + spec.strength * p) / (one[h] + spec.strength))
        want[i, len(ws), round(log, 6)] += 1
    assert got == want


def test_filter_says_no_less_and_seldom_more():
    import numpy as np

    spec, rng = LmSpec(), np.random.default_rng(5)
    grams = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = rng.zipf(1.7, len(grams)).astype(np.int64)
    bits = fill(grams, counts, spec)
    true = np.searchsorted(spec.levels(), counts, side="right")
    found = probe(bits, grams, spec)
    assert (found >= true).all() and (found > true).mean() < 0.01
    assert (probe(bits, np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64)), spec) > 0).mean() < 0.01


def test_repair_query(spark):
    got = {r.conv_id: tuple(r)[1:] for r in q.op13_conversation_repair(spark, SF_DIR).collect()}
    talks = brute.damaged(rows_of("conversations", "conv_id, turn, role, text"))
    assert got == {c: brute.repaired(rows) for c, rows in talks.items()}


def odd_turns():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "u", "", None], ["a.", "b!", "c", "d?", "", "  ", "e. ", None, *(f"x{i}." for i in range(90))]
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)) for c in range(40) for t in range(rng.choice([1, 3, 20, 60]))]
    # One conversation is long, and all users, which hands a difference from chunk to chunk; one has a null id; one is all blank.
    return rows + [(7, i, "user", f"q{i}.") for i in range(500, 700)] + [(None, 1, "user", "hi."), (None, 2, "assistant", "yes."), (50, 1, "user", " "), (50, 2, None, None)]


def test_repair_of_odd_turns(spark):
    turns = odd_turns()
    frame = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, conv string, rn int")
    found = repair(damage(frame), RepairSpec(chunk=4, fan=3))
    got = {r.conv_id: tuple(r)[1:] for r in report(frame, found).collect()}
    assert got == {c: brute.repaired(rows) for c, rows in brute.damaged(turns).items()}
    # Passes follow the number of vectors there can be, not the number of chunks.
    assert 1 <= found.passes <= 6


def test_repair_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert report(frame, repair(damage(frame))).collect() == []
    # A conversation that loses its only turn is still reported.
    lost = next(i for i in range(1000) if not brute.damaged([(i, 0, "user", "a.")])[i])
    frame = spark.createDataFrame([(lost, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in report(frame, repair(damage(frame))).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", brute.sha(""))]
