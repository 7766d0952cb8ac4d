"""Report lines: one row per metric of a KPI row, with formatted text and status; labels and message texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.status import threshold_status


def _pct(c, digits=1):
    return F.format_string(f"%.{digits}f%%", F.round(c * 100, digits))


def _num(c, digits, before="", after=""):
    return F.concat(F.lit(before), F.format_string(f"%.{digits}f", F.round(c, digits)), F.lit(after))


def _whole(c, after=""):
    return F.concat(F.format_string("%.0f", F.bround(c, 0)), F.lit(after))


def _levels(good, warn, inverse=False, middle="Needs Attention"):
    return lambda c: threshold_status(c, good, warn, inverse, inclusive=False, labels=("Good", middle, "Critical"))


def lines(section: str) -> list[tuple]:
    """(label, value column, text builder, status builder or None) of a section, in report order."""
    c = F.col
    if section == "executive":
        return [
            ("Overall Accuracy", c("overall_accuracy"), _pct, None),
            ("Straight-Through Processing Rate", c("stp_rate"), _pct, None),
            ("Exception Rate", c("exception_rate"), _pct, None),
            ("Median Processing Time", c("latency_p50"), lambda x: _num(x, 2, after="s"), None),
            ("95th Percentile Latency", c("latency_p95"), lambda x: _num(x, 2, after="s"), None),
            ("Throughput", c("throughput_docs_per_hour"), lambda x: _whole(x, " docs/hour"), None),
            ("SLA Adherence", c("sla_adherence_rate"), _pct, None),
            ("Cost per Document", c("cost_per_document"), lambda x: _num(x, 3, "$"), None),
            ("Reprocess Rate", c("reprocess_rate"), _pct, None),
            ("Operational Efficiency", 1 - c("exception_rate"), _pct, None),
        ]
    if section == "operational":
        out = [
            ("Processing Accuracy", c("overall_accuracy"), _pct, _levels(0.9, 0.8)),
            ("STP Rate", c("stp_rate"), _pct, _levels(0.8, 0.7)),
            ("Throughput", c("throughput_docs_per_hour"), lambda x: _whole(x, " docs/hr"), _levels(100, None, middle="Monitor")),
            ("P95 Latency", c("latency_p95"), lambda x: _num(x, 2, after="s"), _levels(10, 30, True, "Monitor")),
            ("Poison Queue Count", c("poison_queue_count"), lambda x: x.cast("string"), None),
            ("Reprocess Rate", c("reprocess_rate"), lambda x: _pct(x, 2), None),
        ]
        for part in ("compute", "storage", "review"):
            share = F.try_divide(c(f"{part}_cost_per_doc"), F.nullif(c("cost_per_document"), F.lit(0.0))) * 100
            out.append((f"{part.title()} Cost", c(f"{part}_cost_per_doc"), lambda x: _num(x, 4, "$"), None))
            out.append((f"{part.title()} Share", share, lambda x: _num(x, 1, after="%"), None))
        return [
            *out,
            ("Total Cost", c("cost_per_document"), lambda x: _num(x, 4, "$"), None),
            ("Average Time to First Review", c("time_to_first_review_avg"), lambda x: _num(x, 1, after=" minutes"), None),
            ("Average Time to Resolution", c("time_to_resolution_avg"), lambda x: _num(x, 1, after=" minutes"), None),
            ("Documents Requiring Review", 1 - c("stp_rate"), _pct, None),
        ]
    return [
        ("P50 (Median)", c("latency_p50"), lambda x: _num(x, 3, after="s"), None),
        ("P95", c("latency_p95"), lambda x: _num(x, 3, after="s"), None),
        ("Throughput", c("throughput_docs_per_hour"), lambda x: _num(x, 2, after=" documents/hour"), None),
        ("OCR Accuracy", c("overall_accuracy"), lambda x: _pct(x, 3), None),
        ("Validation Pass Rate", 1 - c("exception_rate"), lambda x: _pct(x, 3), None),
        ("STP Rate", c("stp_rate"), lambda x: _pct(x, 3), None),
        ("Compute Cost/Doc", c("compute_cost_per_doc"), lambda x: _num(x, 6, "$"), None),
        ("Storage Cost/Doc", c("storage_cost_per_doc"), lambda x: _num(x, 6, "$"), None),
        ("Review Cost/Doc", c("review_cost_per_doc"), lambda x: _num(x, 6, "$"), None),
        ("Total Cost/Doc", c("cost_per_document"), lambda x: _num(x, 6, "$"), None),
        ("Reprocess Rate", c("reprocess_rate"), lambda x: _pct(x, 4), None),
        ("Poison Queue Depth", c("poison_queue_count"), lambda x: x.cast("string"), None),
        ("SLA Compliance", c("sla_adherence_rate"), lambda x: _pct(x, 2), None),
    ]


def kpi_report(kpi: DataFrame, sections=("executive", "operational", "technical"), keys=()) -> DataFrame:
    """Unpivots KPI rows to (section, pos, label, value, text, status) lines."""
    have = set(kpi.columns)

    def line(section: str, pos: int, label: str, value: Column, text, status) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(section).alias("section"), F.lit(pos).alias("pos"), F.lit(label).alias("label"),
                        value.cast("double").alias("value"), text(value).alias("text"), (status(value) if status else none).alias("status"))

    optional = {"Average Time to First Review": "time_to_first_review_avg", "Average Time to Resolution": "time_to_resolution_avg"}
    items = [
        line(s, i, *spec) for s in sections for i, spec in enumerate(lines(s))
        if optional.get(spec[0], next(iter(have))) in have
    ]
    return kpi.select(*keys, F.explode(F.array(*items)).alias("l")).select(*keys, "l.*").orderBy(*keys, "section", "pos")
