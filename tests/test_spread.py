"""Rows of few row groups are dealt to all cores, and white space is cut from both ends."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant import session
from foliant.functions import parse
from foliant.plans.queries_stream import spread
from foliant.sources import adapters as A


@pytest.fixture
def unset(spark):
    before = spark.conf.get(session.INPUT_CONF)
    spark.conf.set(session.INPUT_CONF, "0")
    yield
    spark.conf.set(session.INPUT_CONF, before)


def test_orders_of_one_row_group_reach_every_core(spark, unset):
    docs = A.order_docs(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    n = session.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert len(sizes) == n and max(sizes) < 2 * sum(sizes) / n


def test_a_set_number_of_partitions_holds(spark, unset):
    spark.conf.set(session.INPUT_CONF, "3")
    assert spread(spark.range(10), "id").rdd.getNumPartitions() == 3


def test_strip_is_that_of_python(spark):
    texts = [f"{a}x {b}y{c}" for a in ("", "\n", "\x1f ", "​") for b in ("", "\x85") for c in ("", " \n", "　\r\n", " ", "\x00")] + ["", "\xa0\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", parse.strip(F.col("t")).alias("s")).collect():
        assert r["s"] == r["t"].strip()
    plan = df.select(parse.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_white_space_of_patterns_is_that_of_strip(spark):
    df = spark.createDataFrame([(c, chr(c)) for c in range(0x3100)], "id int, c string")
    assert {r["id"] for r in df.where(F.col("c").rlike(parse.WS)).collect()} == {ord(c) for c in parse.WS_TEXT} == {c for c in range(0x3100) if chr(c).isspace()}


def test_key_phrases_sort_without_lambdas(spark):
    from foliant.operators import classify

    df = spark.createDataFrame([("beta beta alpha alpha gamma the the delta",), ("",), (None,), ("one\x1ftwo three\u3000three",)], "t string")
    out = classify.key_phrases(df, "t")
    assert [r["key_phrases"] for r in out.collect()] == [["beta", "alpha", "gamma", "delta"], [], [], ["three"]]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and "sort_array(" in plan


def test_streams_are_dealt_as_well(spark, unset):
    from foliant.streaming.runner import read_stream

    dealt = spread(read_stream(spark, "/root/testdata/sf0.001", "orders"), "o_orderkey")
    assert dealt.isStreaming and "RepartitionByExpression" in dealt._jdf.queryExecution().analyzed().toString()
