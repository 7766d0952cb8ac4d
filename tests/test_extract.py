"""The extraction cascade on hand-made documents, checked against a plain Python reading of its rules."""

import re

import pytest
from pyspark.sql import functions as F

from foliant import config
from foliant.operators import extract as X
from foliant.operators import tables as T
from foliant.plans.documents import process_documents

INVOICE = """INVOICE
Invoice #: INV-2024-001
Date: 1/15/2024
Payment due: 2024-02-15
From: ABC Company
Sub Total: $6,500.00
Tax (8.5%): $552.50
Total: $7,052.50
"""
DOCS = [
    ("a", "invoice", INVOICE), ("b", "receipt", "Store:\nBest Buy\ntotal: 89.99 usd $12 $1,000.10\nmethod: VISA card\nJanuary 20, 2024"),
    ("c", "letter", "dated 2024-01-15, value: 12"), ("d", "invoice", ""), ("e", "contract", "between A and B\nuntil: 1-2-2025\nfoo"),
]


def python_cascade(doc_type, text):
    out = {}
    schema = config.SCHEMAS.get(doc_type, config.GENERIC)
    for f in schema.fields:
        hit = None
        for label in (f.name, *f.synonyms):
            value = config.LABEL_VALUE_PATTERNS.get(f.field_type, config.LABEL_VALUE_PATTERNS["text"])
            m = re.search(rf"(?:^|\s)({re.escape(label)})[:\s]+{value}", text, re.I | re.M)
            if m:
                hit = (m.group(2).strip(), "pattern_match")
                break
        if hit is None and f.field_type == "currency":
            amounts = [float(a.replace("$", "").replace(",", "")) for a in re.findall(config.ANY_CURRENCY, text)]
            hit = (f"${max(amounts):,.2f}", "pattern_currency") if amounts else None
        if hit is None and f.field_type == "date":
            slash, dash, named = config.ANY_DATES
            for p in (slash, r"(?<![0-9-])[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "(?<![0-9])" + dash, named):
                m = re.search(p, text)
                if m:
                    hit = (m.group(0), "pattern_date")
                    break
        if hit:
            out[f.name] = hit
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "document_id string, document_type string, full_text string")


def test_cascade_matches_python(spark, docs):
    rows = X.field_rows(X.extract_fields(docs), ["document_id"]).collect()
    for doc_id, doc_type, text in DOCS:
        got = {r["field_name"]: (r["value"], r["method"]) for r in rows if r["document_id"] == doc_id}
        assert got == python_cascade(doc_type, text), doc_id


def test_label_traps(spark, docs):
    f = {r["field_name"]: r for r in X.field_rows(X.extract_fields(docs.where("document_id = 'a'")), ["document_id"]).collect()}
    assert f["tax_amount"]["method"] == "pattern_currency"  # "Tax (8.5%):" gives no hit for the label
    assert f["due_date"]["method"] == "pattern_date"  # an ISO date does not follow a label
    assert f["invoice_number"]["matched_label"] == "invoice #" and f["invoice_number"]["value"] == "INV-2024-001"
    b = {r["field_name"]: r for r in X.field_rows(X.extract_fields(docs.where("document_id = 'b'")), ["document_id"]).collect()}
    assert b["merchant_name"]["value"] == "Best Buy"  # a lone label takes the next line


def test_compat_lowercases_and_names_by_label(spark, docs):
    f = {r["field_name"]: r["value"] for r in X.field_rows(X.extract_fields(docs.where("document_id = 'a'"), compat=True), ["document_id"]).collect()}
    assert f["invoice #"] == "inv-2024-001" and f["from"] == "abc company"
    c = {r["field_name"]: r["value"] for r in X.field_rows(X.extract_fields(docs.where("document_id = 'c'"), compat=True), ["document_id"]).collect()}
    assert c["dates"] == "24-01-15"


def test_recognised_field_wins(spark, docs):
    kind = "array<struct<field_name:string,value:string,field_type:string,confidence:double>>"
    d = docs.where("document_id = 'a'").withColumn("ocr_fields", F.expr(f"cast(array(named_struct('field_name','TOTAL_AMOUNT','value','$1','field_type','s','confidence',0.9d)) as {kind})"))
    f = {r["field_name"]: r for r in X.field_rows(X.extract_fields(d), ["document_id"]).collect()}
    assert (f["total_amount"]["value"], f["total_amount"]["method"], f["total_amount"]["confidence"]) == ("$1", "ocr_structured", 0.9)


def test_default(spark):
    spec = config.FieldSpec("currency_code", default="it's USD")
    schema = {"x": config.DocSchema("x", fields=(spec,))}
    d = spark.createDataFrame([("1", "x", "nothing")], "document_id string, document_type string, full_text string")
    f = X.field_rows(X.extract_fields(d, schema), ["document_id"]).first()
    assert (f["value"], f["method"], f["confidence"]) == ("it's USD", "default", 0.5)


def test_process_documents_is_one_narrow_stage(spark, docs):
    out = process_documents(docs, "2024-06-01")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    r = {x["document_id"]: x for x in out.collect()}
    assert r["d"]["overall_confidence"] == 0.0 and r["d"]["requires_hitl"] and r["d"]["priority"] == "urgent"
    assert r["c"]["requires_hitl"] is False and r["c"]["routing_reason"] is None


def test_tables(spark):
    kind = "array<struct<rows:array<array<string>>,headers:array<string>,confidence:double>>"
    d = spark.createDataFrame([("1", [{"rows": [["h", "q", "u", "a"], ["pen", "4", "$1.50", "$6.00"], ["ink", "", "x", "$2"]], "headers": [], "confidence": 1.0}]),
                               ("2", [{"rows": [["lone", "1", "2", "3"]], "headers": [], "confidence": 1.0}]), ("3", [])], f"document_id string, tables {kind}")
    spec = config.INVOICE.tables[0]
    cells = {(r["document_id"], r["row"], r["column_name"]): r["value"] for r in T.process_table(d, spec, ["document_id"]).collect()}
    assert cells[("1", 1, "amount")] == "6.0" and cells[("1", 2, "quantity")] is None and cells[("1", 2, "unit_price")] == "x"
    assert cells[("2", 0, "description")] == "lone" and not any(k[0] == "3" for k in cells)
    sums = [r["s"] for r in d.select(T.column_sum(F.col("tables"), spec, "amount").alias("s")).collect()]
    assert [None if s is None else float(s) for s in sums] == [8.0, 3.0, None]


def test_grid_last_cell_wins(spark):
    kind = "array<struct<row_index:int,column_index:int,content:string>>"
    d = spark.createDataFrame([([(0, 0, "a"), (1, 2, "x"), (1, 2, "y"), (0, 1, None)],)], f"cells {kind}")
    assert T.grid_from_cells(d, "cells", "g").first()["g"] == [["a", "", ""], ["", "", "y"]]
