"""Dates are read once per value by code that the JVM compiles; forms that do not fit are not parsed."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from foliant.functions import parse, rules
from foliant.plans import registry
from tests.test_hits import code_sizes

SF_DIR = "/root/testdata/sf0.001"


def test_steps_are_small_enough_for_the_jvm_to_compile(spark):
    registry.load()
    assert max(code_sizes(registry.QUERIES["rule_date_format"](spark, SF_DIR))) < 8000


def test_a_date_is_looked_for_once(spark):
    found = rules.date_found(F.col("v"), ("%d.%m.%Y",))
    df = spark.createDataFrame([("1.2.2024",), ("x",), ("",), (None,), ("13/2/2024",)], "v string")
    out = df.select("v", rules.rule_date_format(F.col("v"), ("%d.%m.%Y",)).alias("r"), found.alias("found"))
    got = {r["v"]: (r["r"]["is_valid"], r["r"]["severity"], r["r"]["message"], r["r"]["suggested_value"]) for r in out.collect()}
    failed = "Date format validation failed. Tried formats: ['%d.%m.%Y']"
    assert got == {
        "1.2.2024": (True, "info", "Date parsed with format %d.%m.%Y: 2024-02-01", "2024-02-01"), "x": (False, "error", failed, None),
        "": (False, "error", "Empty date value", None), None: (False, "error", "Empty date value", None),
        "13/2/2024": (True, "info", "Date parsed successfully: 2024-02-13", "2024-02-13")}


def as_date(y, m, d):
    try:
        return date(y, m, d)
    except ValueError:
        return None


def test_numbers_are_month_first_and_else_day_first(spark):
    pairs = [(a, b) for a in range(100) for b in range(100)]
    df = spark.createDataFrame([(a, b, f"{a}/{b:02d}/2023") for a, b in pairs], "a int, b int, t string")
    for r in df.select("a", "b", parse.to_date(F.col("t")).alias("d")).collect():
        assert r["d"] == (as_date(2023, r["a"], r["b"]) or as_date(2023, r["b"], r["a"])), (r["a"], r["b"])


def test_names_of_months_take_one_day(spark):
    cases = {"Jan 5, 2024": date(2024, 1, 5), "5 JANUARY 2024": date(2024, 1, 5), "05 sept, 2024": None, "5 sep, 2024": date(2024, 9, 5), "5 se 2024": None, "June 31 2024": None,
             "1 jan 2 2024": None, "jan 2024": None, "May 12": None, " 7 may 2024 ": date(2024, 5, 7), "March5 2024": None, "1 2 2024": None,
             "2024-1-5": date(2024, 1, 5), "2024-1-5 7:30": date(2024, 1, 5), "2024-13-01": None, "1/2/24": date(2024, 1, 2)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", parse.to_date(F.col("t")).alias("d")).collect()} == cases


@pytest.mark.parametrize("fmt,pattern", [("%Y-%m-%d", "yyyy-M-d"), ("%d.%m.%Y", "d.M.yyyy"), ("%d %B %Y", "d MMMM yyyy"), ("%b/%d/%y", "MMM/d/yy"),
                                         ("%dof%m,%Y", "d'of'M,yyyy"), ("%Y%m", "yyyyM"), ("%d.%m.%Y %H:%M:%S", "d.M.yyyy H:m:s")])
def test_the_look_before_parsing_loses_nothing(spark, fmt, pattern):
    texts = ["2024-1-5", "2024-01-05", "+12024-01-05", "-2024-01-05", "5.1.2024", "05.01.2024", " 5.1.2024 ", "5 January 2024", "5 january 2024", "Jan/5/24", "jan/05/2024",
             "5of1,2024", "5OF01,2024", "20241", "202412", "5.1.2024 7:30:00", "5.1.2024\n", "soon", "", "5x1x2024", "-5.1.2024", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.to_date(F.try_to_timestamp(F.trim("t"), F.lit(pattern)))
    for r in df.select("t", parse.date_by_format(F.col("t"), fmt).cast("string").alias("a"), plain.cast("string").alias("b")).collect():
        assert r["a"] == r["b"], r["t"]
