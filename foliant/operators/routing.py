"""Document confidence, review decision, routing and the metrics row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config
from foliant.config import DocSchema
from foliant.operators.extract import by_name, by_type
from foliant.sources.metrics import plus_seconds


def count_failed(results: Column, severity: str) -> Column:
    return F.size(F.filter(results, lambda r: ~r["is_valid"] & (r["severity"] == severity)))


def penalized(mean: Column, errors: Column, warnings: Column) -> Column:
    """Mean confidence less 0.1 per error and 0.05 per warning, within 0 and 1; 0 without fields."""
    # The greatest passes over NULL, so a mean that is none counts as 0 without being asked for twice.
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean - errors * 0.1 - warnings * 0.05))


def overall_confidence(fields: Column, results: Column) -> Column:
    mean = F.when(F.size(fields) > 0, F.aggregate(fields, F.lit(0.0), lambda a, f: a + f["confidence"]) / F.size(fields))
    return penalized(mean, count_failed(results, "error"), count_failed(results, "warning"))


def overall_confidence_rows(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Long form: rows of (key, confidence, valid, severity)."""
    bad = lambda s: F.count_if(~F.col("valid") & (F.col("severity") == s))
    return rows.groupBy(key).agg(penalized(F.avg("confidence"), bad("error"), bad("warning")).alias("overall_confidence"))


def missing_required(document_type: Column, fields: Column, schemas: dict[str, DocSchema] | None = None) -> Column:
    """Names of the required fields that are absent or below their threshold."""
    def build(schema: DocSchema) -> Column:
        lacking = [
            F.when(~F.coalesce(by_name(fields, s.name)["confidence"] >= s.threshold, F.lit(False)), F.lit(s.name))
            for s in schema.fields if s.required
        ]
        return F.filter(F.array(*lacking), lambda n: n.isNotNull()) if lacking else F.array().cast("array<string>")

    return by_type(document_type, config.SCHEMAS if schemas is None else schemas, build)


def required_confidence(document_type: Column, schemas: dict[str, DocSchema] | None = None) -> Column:
    return by_type(document_type, config.SCHEMAS if schemas is None else schemas, lambda s: F.lit(float(s.required_confidence)))


def requires_review(confidence: Column, missing: Column, errors: Column, needed: Column, threshold: float = config.HITL_THRESHOLD) -> Column:
    return (confidence < threshold) | (F.size(missing) > 0) | (errors > 0) | (confidence < needed)


def route(docs: DataFrame, schemas: dict[str, DocSchema] | None = None, type_col: str = "document_type", compat: bool = False) -> DataFrame:
    """Adds confidence, missing fields, review flag, reason, priority and auto-approval to validated documents.

    By default an absent named field counts as missing; ``compat`` only looks at fields that are there.
    """
    t, fields, results = F.col(type_col), F.col("fields"), F.col("validation_results")
    step = docs.withColumns({
        "overall_confidence": overall_confidence(fields, results), "missing_required": missing_required(t, fields, schemas),
        "error_count": count_failed(results, "error")})
    step = step.withColumn("requires_hitl", requires_review(
        F.col("overall_confidence"), F.col("missing_required"), F.col("error_count"), required_confidence(t, schemas)))
    weak = F.exists(fields, lambda f: f["field_name"].isin(*config.NAMED_FIELDS) & (f["confidence"] < config.NAMED_FIELD_THRESHOLD))
    if not compat:
        weak = weak | F.exists("missing_required", lambda n: n.isin(*config.NAMED_FIELDS))
    return step.withColumns(decision(F.col("requires_hitl"), F.col("overall_confidence"), F.col("error_count"), weak))


def decision(review: Column, confidence: Column, errors: Column, weak_named_field: Column) -> dict[str, Column]:
    """Reason and priority; the last rule that fits wins, so it is asked first."""
    low = confidence < config.HITL_THRESHOLD
    return {
        "routing_reason": F.when(review, F.when(weak_named_field, "missing_required_field").when(errors > 0, "validation_error").when(low, "low_confidence")),
        "priority": F.when(review & weak_named_field, "urgent").when(review & ((errors > 0) | low), "high").otherwise("normal"),
        "auto_approve": ~review & (confidence >= config.AUTO_APPROVE_THRESHOLD),
    }


def route_simple(docs: DataFrame, threshold: float = config.LOW_FIELD_THRESHOLD) -> DataFrame:
    """Adds ``reasons`` and ``route`` from validation results and a confidence map; weak fields are named in alphabetical order."""
    failed = F.transform(
        F.filter("validation_results", lambda r: ~r["is_valid"] & (r["severity"] == "error")),
        lambda r: F.concat(F.lit("Validation failed: "), r["message"]))
    low = F.array_sort(F.transform(F.filter(F.map_entries("confidence_scores"), lambda e: e["value"] < threshold), lambda e: e["key"]))
    lines = F.concat(failed, F.when(F.size(low) > 0, F.array(F.concat(F.lit("Low confidence fields: "), F.array_join(low, ", ")))).otherwise(
        F.array().cast("array<string>")))
    return docs.withColumn("reasons", lines).withColumn("route", F.size("reasons") > 0)


def review_priority(results: Column, scores: Column) -> Column:
    errors = count_failed(results, "error")
    bad = F.size(F.filter(results, lambda r: ~r["is_valid"]))
    low = F.size(F.filter(F.map_values(scores), lambda s: s < 0.6))
    return F.when((errors > 0) | (low > 2), "high").when((bad > 0) | (low > 0), "medium").otherwise("low")


def run_review_flag(stages: Column, results: Column) -> Column:
    failed = F.exists(stages, lambda s: s["status"] == "failed")
    return failed | (F.size(F.filter(results, lambda r: ~F.coalesce(r["valid"], F.lit(False)))) > 2)


def derive_metrics_row(results: DataFrame) -> DataFrame:
    """Run results to ``document_metrics`` rows."""
    failed = F.filter("stages", lambda s: s["status"] == "failed")
    bad = F.size(F.filter("validation_results", lambda r: ~F.coalesce(r["valid"], F.lit(True))))
    t, review = F.col("processing_time"), F.col("needs_human_review")
    return results.select(
        F.regexp_replace(F.replace("blob_name", F.lit(".pdf"), F.lit("")), "/", "_").alias("document_id"), "document_type",
        F.when(F.size(failed) > 0, "failed").when(review, "needs_review").otherwise("success").alias("processing_status"),
        F.col("timestamp").alias("start_time"), plus_seconds(F.col("timestamp"), t).alias("end_time"), t.alias("total_processing_time"),
        F.coalesce("field_count", F.lit(0)).alias("field_count"), review.alias("hitl_required"),
        F.when(review, F.when(bad > 0, F.concat(F.lit("Validation failures: "), bad.cast("string"), F.lit(" fields"))).otherwise("Low confidence scores")).alias("hitl_reason"),
        F.get(failed, F.lit(0))["name"].alias("exception_type"),
        F.create_map(F.lit("compute_cost"), F.greatest(F.lit(0.001), t * 0.0001), F.lit("storage_cost"), F.lit(0.0001),
                     F.lit("review_cost"), F.when(review, 0.05).otherwise(0.0)).alias("cost_breakdown"),
        F.transform_values("extracted_data", lambda k, v: v["confidence"]).alias("confidence_scores"),
        F.col("timestamp").alias("created_at"),
    )
