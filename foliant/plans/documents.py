"""The document plan: extract, validate, route. One narrow stage over document rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.config import DocSchema
from foliant.operators.extract import extract_fields
from foliant.operators.routing import route
from foliant.operators.validate import validate_fields


def process_documents(docs: DataFrame, as_of, schemas: dict[str, DocSchema] | None = None, compat: bool = False) -> DataFrame:
    """Documents (batch or streaming) with fields, validation results and routing columns; no shuffle."""
    return route(validate_fields(extract_fields(docs, schemas, compat=compat), as_of, schemas), schemas, compat=compat)


def run_steps(df: DataFrame, steps) -> DataFrame:
    """Applies named DataFrame functions in order; each is a callable or (name, callable)."""
    for step in steps:
        df = df.transform(step[1] if isinstance(step, tuple) else step)
    return df


def metrics_rows(docs: DataFrame) -> DataFrame:
    """Processed documents to ``document_metrics`` rows."""
    t = F.col("processing_time")
    review = F.col("requires_hitl")
    return docs.select(
        "document_id", "document_type", F.when(review, "needs_review").otherwise("success").alias("processing_status"),
        F.col("created").alias("start_time"), t.alias("total_processing_time"), F.size("fields").alias("field_count"),
        review.alias("hitl_required"), F.col("routing_reason").alias("hitl_reason"), F.lit(None).cast("string").alias("exception_type"),
        F.create_map(F.lit("compute_cost"), F.greatest(F.lit(0.001), t * 0.0001), F.lit("storage_cost"), F.lit(0.0001),
                     F.lit("review_cost"), F.when(review, 0.05).otherwise(0.0)).alias("cost_breakdown"),
        F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field_name"], f["confidence"]))).alias("confidence_scores"))
