"""Running totals of the processing steps as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import config


def extraction_stats(docs: DataFrame, group_cols=()) -> DataFrame:
    """Input: field_count, error_count, requires_hitl, processing_time per document."""
    return docs.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("documents_processed"), F.sum("field_count").alias("fields_extracted"),
        F.sum("error_count").alias("validation_errors"), F.count_if("requires_hitl").alias("hitl_documents"),
        F.avg("field_count").alias("average_fields_per_document"), F.avg("processing_time").alias("average_processing_time"),
        F.avg(F.col("requires_hitl").cast("double")).alias("hitl_rate"),
    )


def routing_stats(docs: DataFrame, group_cols=()) -> DataFrame:
    return docs.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("documents_processed"), F.count_if("auto_approve").alias("auto_approved"),
        F.count_if("requires_hitl").alias("sent_to_hitl"), F.avg("overall_confidence").alias("average_confidence"),
        F.avg(F.col("auto_approve").cast("double")).alias("auto_approval_rate"),
        F.avg(F.col("requires_hitl").cast("double")).alias("hitl_rate"), F.avg("processing_time").alias("average_processing_time"),
    )


def ocr_stats(docs: DataFrame, group_cols=()) -> DataFrame:
    text = F.try_element_at("confidence_scores", F.lit("text"))
    return docs.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("documents_processed"), F.sum("processing_time").alias("total_processing_time"),
        F.avg("processing_time").alias("average_processing_time"), F.avg(F.when(text > 0, text)).alias("average_confidence"),
        F.sum(F.size(F.filter("text_blocks", lambda b: b["is_handwritten"]))).alias("handwritten_text_detected"),
        F.sum(F.size("tables")).alias("tables_extracted"), F.sum(F.size("ocr_fields")).alias("custom_fields_extracted"),
    )


def preprocess_stats(pages: DataFrame, group_cols=()) -> DataFrame:
    """Input: one row per page with skew_angle and processing_time."""
    return pages.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total_pages"), F.avg("skew_angle").alias("average_skew"),
        F.max(F.abs("skew_angle")).alias("max_skew"), F.avg("processing_time").alias("average_processing_time"))


def stage_summary(results: DataFrame) -> DataFrame:
    def n(status):
        return F.size(F.filter("stages", lambda s: s["status"] == status))

    total = F.size("stages")
    return results.withColumns({
        "total_stages": total, "completed_stages": n("completed"), "failed_stages": n("failed"),
        "success_rate": F.when(total > 0, n("completed") / total).otherwise(F.lit(0.0)),
    })


def batch_summary(results: DataFrame, group_cols=()) -> DataFrame:
    failed = F.exists("stages", lambda s: s["status"] == "failed")
    return results.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total_documents"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"),
        F.coalesce(F.avg((~failed).cast("double")), F.lit(0.0)).alias("success_rate"))


def validation_counts(results: DataFrame) -> DataFrame:
    """Passed and failed checks per document, from its array of results."""
    return results.withColumns({
        "passed": F.size(F.filter("validation_results", lambda r: r["valid"])),
        "failed": F.size(F.filter("validation_results", lambda r: ~r["valid"])),
    })


def class_distribution(df: DataFrame, label: str = "document_type") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def classification_stats(df: DataFrame, group_cols=()) -> DataFrame:
    t = F.col("processing_time")
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total_classified"), F.avg("confidence").alias("avg_confidence"), F.avg(t).alias("avg_processing_time"),
        F.min(t).alias("min_processing_time"), F.max(t).alias("max_processing_time"))


def retrain_gate(df: DataFrame, label: str = "label", min_samples: int = 10, min_classes: int = 2) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest_class"),
        ((F.count(F.lit(1)) >= min_classes) & (F.min("n") >= min_samples)).alias("should_retrain"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[fn(c).alias(f"distinct_{c}") for c in columns])


def field_quality_proxy(fields: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy estimated from confidence and validity."""
    c, ok = F.col("confidence"), F.col("valid")

    def estimate(name: str) -> Column:
        (most, up), (least, down) = config.QUALITY_PROXY[name]
        return F.when(ok, F.least(F.lit(most), c + up)).otherwise(F.greatest(F.lit(least), c - down))

    p, r, a = (estimate(n) for n in ("precision", "recall", "accuracy"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return fields.withColumns({
        "precision": F.round(p, 4), "recall": F.round(r, 4), "f1_score": F.round(f1, 4), "accuracy": F.round(a, 4),
        "total_predictions": F.lit(1), "confidence_avg": F.round(c, 4)})


def field_quality_truth(pred: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per field: counts and rates of predictions against labels; both frames hold one value per key."""
    j = pred.join(truth, keys, "full_outer")
    p, t = F.col("predicted"), F.col("actual")
    tp = F.count_if(p.isNotNull() & t.isNotNull() & (p == t))
    fp = F.count_if(p.isNotNull() & (t.isNull() | (p != t)))
    fn = F.count_if(t.isNotNull() & (p.isNull() | (p != t)))
    agg = j.groupBy(*by).agg(
        tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), F.count(F.lit(1)).alias("total_predictions"),
        F.avg("confidence").alias("confidence_avg"), F.stddev_samp("confidence").alias("confidence_std"))
    prec = F.try_divide(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))
    rec = F.try_divide(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives"))
    return agg.withColumns({
        "precision": prec, "recall": rec, "f1_score": F.try_divide(2 * prec * rec, prec + rec),
        "accuracy": F.try_divide(F.col("true_positives"), F.col("total_predictions"))})
