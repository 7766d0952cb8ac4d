"""Joins between fields, schemas, validations and reviewers.

No broadcast hints: configuration becomes VALUES relations, whose size the planner knows and below its
threshold broadcasts, and every other side is left to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant import config
from foliant.config import DocSchema
from foliant.sources.literals import literal_frame


def schema_fields(spark: SparkSession, schemas: dict[str, DocSchema] | None = None) -> DataFrame:
    """The document schemas as a table of fields."""
    rows = [
        (s.document_type, i, f.name, f.field_type, f.required, f.threshold, list(f.synonyms), list(f.rules), f.default, s.required_confidence)
        for s in (config.SCHEMAS if schemas is None else schemas).values() for i, f in enumerate(s.fields)
    ]
    return literal_frame(spark, rows, (
        "document_type string, pos int, field_name string, field_type string, required boolean, confidence_threshold double, "
        "synonyms array<string>, validation_rules array<string>, default_value string, required_confidence double"))


def join_fields_schema(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Each extracted field with its schema; fields the schema does not know are skipped."""
    return rows.join(fields, ["document_type", "field_name"])


def last_validation(validations: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The last verdict per key, taken by an aggregate with map-side partials."""
    return validations.groupBy(*keys).agg(F.max_by("valid", order).alias("valid"))


def join_field_validation(rows: DataFrame, validations: DataFrame, keys: list[str]) -> DataFrame:
    """Fields with their verdict; fields without one count as valid."""
    j = rows.join(last_validation(validations, keys), keys, "left")
    return j.withColumn("valid", F.coalesce("valid", F.lit(True)))


def missing_required_rows(docs: DataFrame, rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Long form: (document_id, field_name) of required fields absent or below their threshold.

    Best confidence per document and field first, then one left join from the required list of each
    document's type.
    """
    best = rows.groupBy("document_id", "field_name").agg(F.max("confidence").alias("confidence"))
    needed = docs.select("document_id", "document_type").join(
        fields.where("required").select("document_type", "field_name", "confidence_threshold"), "document_type")
    met = F.coalesce(F.col("confidence") >= F.col("confidence_threshold"), F.lit(False))
    return needed.join(best, ["document_id", "field_name"], "left").where(~met).select("document_id", "field_name")


def anti_processed(new: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    """Names not yet processed."""
    return new.join(processed.select(key).distinct(), key, "left_anti")


def semi_expected(detected: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return detected.join(expected, keys, "left_semi")


def import_reviews(tasks: DataFrame, metrics: DataFrame) -> DataFrame:
    """The newest finished review of each document that is not in the metrics yet, as a metric row."""
    done = tasks.where(F.col("status").isin("completed", "approved"))
    new = done.join(metrics.select("document_id").distinct(), "document_id", "left_anti")
    newest = new.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in tasks.columns if c != "document_id"]), F.struct("created_at", "task_id")).alias("t"))
    return newest.select("document_id", "t.*").select(
        "document_id", F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
        F.when(F.col("status") == "completed", "success").otherwise("needs_review").alias("processing_status"),
        F.col("created_at").alias("start_time"), F.coalesce("resolution_time", "created_at").alias("end_time"),
        F.lit(config.IMPORT_SECONDS).alias("total_processing_time"), F.coalesce(F.size("extracted_fields"), F.lit(0)).alias("field_count"),
        F.lit(True).alias("hitl_required"),
        F.when(F.size("validation_errors") > 0, F.array_join("validation_errors", "; ")).otherwise("Required human review").alias("hitl_reason"),
        F.lit(None).cast("string").alias("exception_type"), F.create_map(F.lit("review"), F.lit(config.IMPORT_COST)).alias("cost_breakdown"),
        F.create_map(F.lit("overall"), F.lit(config.IMPORT_CONFIDENCE)).alias("confidence_scores"))


def reviewers_by_type(reviewers: DataFrame) -> DataFrame:
    """Per specialisation: how many reviewers are free, and the one with the least work (first on ties)."""
    return (
        reviewers.where("is_available").select("user_id", "current_workload", "ord", F.explode("specializations").alias("document_type"))
        .groupBy("document_type")
        .agg(F.count(F.lit(1)).alias("eligible"), F.min_by("user_id", F.struct("current_workload", "ord")).alias("best_reviewer"))
    )


def match_reviewers(tasks: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Tasks with the number of eligible reviewers and the least loaded one; pairs are never spelled out."""
    return tasks.join(reviewers_by_type(reviewers), "document_type")


def feedback_to_field(feedback: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Feedback beside the originally extracted field."""
    return feedback.join(fields, keys)


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per group; the limit applies before the shuffle as well."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
