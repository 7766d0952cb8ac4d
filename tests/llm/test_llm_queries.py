"""The queries of the subpackage over the smallest tables: against SQL, or against brute force, exact round trips or held-out rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import queries as q
from foliant.llm.packing import PackSpec
from foliant.llm.quality import fit, grade, sample
from tests.compare import compare, connect
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


def rows_of(table, columns):
    return duckdb.sql(f"select {columns} from '{SF_DIR}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return dict(rows_of("documents", "doc_id, text"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PackSpec().files.tokenizer)


def token_ids(tokenizer, texts):
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, name):
    assert compare(q.QUERIES[name](spark, SF_DIR), connect(SF_DIR), q.SQL[name]) == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14))


def test_html(spark, docs):
    got = {r.page_id: r for r in q.op1_html_extraction(spark, SF_DIR).collect()}
    pages = rows_of("pages", "page_id, try_cast(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) as bigint)")
    assert len(got) == len(pages)
    for page, doc in pages:
        lines = [" ".join(x.split()) for x in docs[doc].split("\n")]
        body = got[page].text.split("\n")
        # The title, and then the lines of the document that the page was made from.
        assert body[1:] == [x for x in lines if x] and got[page].n_chars == len(got[page].text)


def test_chat(spark):
    talks = {-1: [(0, "user", q.CONTROL_TEXT), (1, "assistant", q.CONTROL_TEXT)]}
    for conv, turn, role, text in rows_of("conversations", "conv_id, turn, role, text"):
        talks.setdefault(conv, []).append((turn, role, text))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in q.op2_chat_formatting(spark, SF_DIR).collect()}
    assert got == {c: brute.conversation([t[1:] for t in sorted(turns, key=lambda t: t[0])]) for c, turns in talks.items()}


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = q.table(spark, sf_dir, "documents"), q.graded_labels(spark, sf_dir)
    fit_on, held = labels.where("doc_id % 4 > 0"), labels.where("doc_id % 4 = 0")
    model = fit(sample(docs, fit_on, q.QUALITY), q.QUALITY)
    assert list(model.thresholds) == sorted(model.thresholds)
    scored = grade(docs.join(held, "doc_id", "left_semi"), model, q.QUALITY).join(held, "doc_id")
    share = {r["grade"]: r["share"] for r in scored.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[2] > 0.98 and share[1] < 0.15 and share[0] < 0.05


def test_packing(spark, docs, tokenizer):
    rows = q.op4_best_fit_packing(spark, SF_DIR).collect()
    used = brute.full_packing(rows, token_ids(tokenizer, docs), PackSpec().size)
    assert used == brute.best_fit_decreasing([r.length for r in rows], PackSpec().size)


def test_near_copies(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in q.op5_near_dedup(spark, SF_DIR).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute.near_components(docs).items()}


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in q.op8_secret_scan(spark, SF_DIR).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        base, r = brute.base_secrets(text), got[i]
        assert [x for x in r.spans.split(",") if x and not x.startswith("live:")] == base
        assert r.base_sha256 == brute.sha(",".join(base)) and r.n_assign + r.n_access + r.n_hex == len(base)


def test_nearest(spark):
    import numpy as np

    vectors = rows_of("embeddings", "vec_id, embedding")
    ids, x = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors], dtype=np.float64)
    got = {}
    for r in q.op10_nearest_vectors(spark, SF_DIR).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for i in np.nonzero(ids % 20 == 0)[0]:
        scores = {int(v): float(s) for v, s in zip(ids, x @ x[i]) if v != ids[i]}
        mine = sorted(got[int(ids[i])])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(scores[v] - s) < 1e-12 for _, v, s in mine) and [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (-m[1], m[0]))
        hit += len({v for _, v, _ in mine} & set(sorted(scores, key=lambda v: (-scores[v], v))[:20]))
        total += 20
    assert hit / total >= 0.9


def test_pipeline(spark, docs, tokenizer, tmp_path):
    """Each stage against brute force on what the one before it kept."""
    stages, frame = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert list(stages) == ["quality", "exact_copies", "near_copies", "mixture", "packing"]
    columns, kept = frame.dtypes, {}
    for name in list(stages)[:-1]:
        stages[name](spark, frame, SF_DIR).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        assert frame.dtypes == columns
        kept[name] = [(r.doc_id, r.text) for r in frame.collect()]
    first = dict(kept["quality"])
    assert all(docs[i] == t for i, t in first.items())
    last = {}
    for i, t in first.items():
        key = (t or "").translate(brute.FOLD)
        last[key] = max(i, last.get(key, i))
    assert sorted(i for i, _ in kept["exact_copies"]) == sorted(last.values())
    expected = {c for _, c in brute.near_components(dict(kept["exact_copies"])).values()}
    assert sorted(i for i, _ in kept["near_copies"]) == sorted(expected)
    assert {i for i, _ in kept["mixture"]} <= expected and len(kept["mixture"]) > len(expected) / 2
    packed = stages["packing"](spark, frame, SF_DIR).collect()
    ids = token_ids(tokenizer, dict(kept["mixture"]))
    assert sum(r.length for r in packed) == sum(len(ids[i]) for i, _ in kept["mixture"])
