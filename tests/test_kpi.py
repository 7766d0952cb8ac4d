"""KPI edge cases: quantiles, empty and zero input, both cost key styles, hot groups."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from foliant.operators import kpi, quantiles
from foliant.operators.quantiles import exact_quantiles, p50, p95
from foliant.operators.ranking import row_numbers

SCHEMA = ("document_id string, document_type string, processing_status string, start_time timestamp, total_processing_time double, hitl_required boolean, "
          "exception_type string, cost_breakdown map<string,double>")


def metrics(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, t=1.0, cost=None, status="success", minute=0):
    return (f"d{i}", "invoice", status, dt.datetime(2024, 1, 1, 0, minute % 60), t, False, None, cost)


def expected(values):
    return statistics.median(values), (statistics.quantiles(values, n=20)[18] if len(values) >= 20 else max(values))


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 37, 100, 1999, 2001, 30000])
def test_quantiles(spark, n):
    rng = random.Random(n)
    values = [round(rng.expovariate(0.1), 2) for _ in range(n)]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [p50("a"), p95("b")]).first()
    assert (got["a"], got["b"]) == pytest.approx(expected(values))


def test_quantiles_hot_group_and_repeated_values(spark):
    rows = [("hot", float(i % 7)) for i in range(20000)] + [("b", 1.0)] * 30 + [("c", float(i)) for i in range(25)] + [("d", None)]
    got = {r["g"]: (r["a"], r["b"]) for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [p50("a"), p95("b")], ["g"]).collect()}
    assert set(got) == {"hot", "b", "c"}
    for g in got:
        assert got[g] == pytest.approx(expected([v for k, v in rows if k == g]))


def test_quantiles_with_few_bins(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 3)
    values = [((i * 7919) % 10007) / 7 for i in range(10007)]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [p50("a"), p95("b")]).first()
    assert (got["a"], got["b"]) == pytest.approx(expected(values))


def test_no_cross_product_and_no_single_window(spark):
    df = metrics(spark, [row(i, float(i)) for i in range(50)])
    plan = kpi.kpi_dashboard(df, "2024-01-01", "2024-01-02", group_cols=["document_type"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_period_gives_zeros(spark):
    df = metrics(spark, [row(1)])
    r = kpi.kpi_dashboard(df, "2030-01-01", "2030-01-02").collect()
    assert len(r) == 1 and r[0]["total_documents"] == 0 and r[0]["latency_p95"] == 0.0 and r[0]["overall_accuracy"] == 0.0


def test_period_includes_both_ends(spark):
    df = metrics(spark, [row(0, minute=0), row(1, minute=10), row(2, minute=11)])
    assert kpi.kpi_dashboard(df, "2024-01-01 00:00:00", "2024-01-01 00:10:00").first()["total_documents"] == 2


def test_all_times_zero(spark):
    r = kpi.kpi_dashboard(metrics(spark, [row(i, 0.0) for i in range(3)]), "2024-01-01", "2024-01-02").first()
    assert (r["latency_p50"], r["throughput_docs_per_hour"], r["sla_adherence_rate"]) == (0.0, 0.0, 0.0)


def test_cost_keys_and_missing_maps(spark):
    df = metrics(spark, [row(0, cost={"compute": 1.0, "storage": 2.0}), row(1, cost={"compute_cost": 3.0, "review_cost": 4.0}), row(2, cost=None), row(3, cost={})])
    r = kpi.kpi_cost(df).first()
    assert (r["cost_per_document"], r["compute_cost_per_doc"], r["storage_cost_per_doc"], r["review_cost_per_doc"]) == (5.0, 2.0, 1.0, 2.0)


def test_zero_cost_share_is_null(spark):
    r = kpi.cost_share(kpi.kpi_cost(metrics(spark, [row(0, cost={"compute": 0.0})]))).first()
    assert r["compute_pct"] is None and r["monthly_cost"] == 0.0


def test_row_numbers_over_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
                                  (F.hash("id") % 10).alias("o"), "id")
    out = row_numbers(df, ["g"], ["o", "id"], "k").collect()
    by_group = {}
    for r in out:
        by_group.setdefault(r["g"], []).append((r["o"], r["id"], r["k"]))
    assert len(out) == 5000
    for rows in by_group.values():
        assert [k for _, _, k in sorted(rows)] == list(range(1, len(rows) + 1))


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    metrics(spark, [row(1)]).write.parquet(path)
    plan = kpi.kpi_quality(kpi.in_period(spark.read.parquet(path), "2024-01-01", "2024-01-02"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(start_time" in plan and "cost_breakdown" not in plan


def test_dashboard_reads_the_period_twice(spark, tmp_path):
    """One read gives all sums and the brackets, one counts; no row is shuffled by type, and the plan left over is small."""
    from foliant.sources import adapters as A

    reads = []
    path = str(tmp_path / "events")
    A.table(spark, "/root/testdata/sf0.001", "events").write.parquet(path)

    def listener(df):
        reads.append(df._jdf.queryExecution().executedPlan().toString().count(path))
        return real(df)

    from foliant.operators import kpi as K
    from foliant.operators import quantiles as QU

    real = K.materialize
    K.materialize = QU.materialize = listener
    try:
        out = K.kpi_dashboard(A.events_as_metrics(spark.read.parquet(path)), "2024-01-05", "2024-01-20", group_cols=["document_type"])
    finally:
        K.materialize = QU.materialize = real
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert reads == [1, 1] and path not in plan
    assert plan.split("== Initial Plan ==")[-1].count("Exchange ") < 15
