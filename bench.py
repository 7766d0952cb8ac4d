"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and BENCH_RUNS times (default 1) for its median; results go to the
noop sink, so a run computes every column of every row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from foliant.plans import registry
from foliant.session import local_session

HEADLINE = [
    "kpi_dashboard", "kpi_dashboard_by_type", "latency_p95", "kpi_by_doc_type", "kpi_cost", "top_exceptions", "kpi_realtime", "kpi_trend",
    "queue_trend", "scan_metrics_period", "recent_documents", "upsert_document_metrics", "derive_metrics_row", "sink_csv_flat",
    "extract_fields", "process_documents", "process_table", "layout_from_blocks", "analysis_json", "validate_fields", "validate_document",
    "rule_luhn", "line_items_sum", "overall_confidence", "route_reason_priority", "join_field_validation", "missing_required",
    "classify_keywords", "score_prebuilt_models", "vote_pages", "text_features", "key_phrases", "mask_pii", "train_classifier",
    "assign_reviewers", "collect_feedback", "training_summary", "task_state", "stream_kpis", "stream_task_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench", input_partitions=2 * cpus)  # each test table is one row group
    registry.load()

    def once(name: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        return time.perf_counter() - start

    out = {}
    for name in names:
        once(name)
        out[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: {out[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
