"""Labels are looked for in a short text, hits are found in a compiled step, and steps are small enough for the JVM to compile."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from foliant.config import DocSchema, FieldSpec
from foliant.operators import extract as X
from foliant.operators.routing import penalized
from foliant.sources import adapters as A


def code_sizes(df):
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]


def test_order_text_is_small_enough_for_the_jvm_to_compile(spark):
    assert max(code_sizes(A.order_text(A.order_docs(spark, "/root/testdata/sf0.001")))) < 8000


def test_label_hits_are_searched_once_and_outside_of_arrays(spark):
    df = spark.createDataFrame([("d", "invoice", "Date: 1/2/2024")], "document_id string, document_type string, full_text string")
    plan = X.extract_fields(df)._jdf.queryExecution().optimizedPlan().toString()
    assert X.HITS in plan and "array_contains(" not in plan and "nullif" not in X.hit_sql(FieldSpec("date", "date"))


@pytest.mark.parametrize("compat", [False, True])
def test_labels_inside_longer_ones(spark, compat):
    schema = DocSchema("t", fields=(FieldSpec("due", synonyms=("pay",)), FieldSpec("due date", "date"), FieldSpec("date", "date")))
    texts = ["due date: 1/2/2024", "DUE DATE: 3/4/2024\ndate 5/6/2024", "overdue: 1\npay: now", "due: x", "", None, "due\tdate: 7/8/2024"]
    df = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "id int, document_type string, full_text string")
    out = X.extract_fields(df, {"t": schema}, compat=compat).collect()
    got = {r["id"]: {f["matched_label"] if compat else f["field_name"]: f["value"] for f in r["fields"] if f["method"] == "pattern_match"} for r in out}
    low = str.lower if compat else str
    want = {}
    for i, t in enumerate(texts):
        want[i] = {}
        for f in schema.fields:
            for label in (f.name, *f.synonyms):
                value = r"([^\n\r]+)" if f.field_type == "text" else r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})"
                m = re.search(rf"(?:^|\s){re.escape(label)}[:\s]+{value}", low(t or ""), re.I | re.M)
                if m:
                    want[i][label if compat else f.name] = m.group(1).strip()
                    break
    assert got == want


def test_a_mean_that_is_none_counts_as_zero(spark):
    df = spark.createDataFrame([(None, 0, 0), (0.9, 1, 1), (0.1, 3, 0), (1.0, 0, 0)], "m double, e int, w int")
    assert [round(r[0], 6) for r in df.select(penalized(F.col("m"), F.col("e"), F.col("w"))).collect()] == [0.0, 0.75, 0.0, 1.0]
