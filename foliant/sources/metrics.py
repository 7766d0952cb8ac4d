"""Reading the metric tables: canonical values, periods, stored JSON maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.sinks.versioned import NULL_PART, VersionedTable

STATUS_SYNONYMS = {"completed": "success", "hitl_required": "needs_review"}


def ts(value, like: DataFrame, column: str) -> Column:
    """A literal of the column's own timestamp type, so comparisons still reach the parquet scan."""
    kind = like.schema[column].dataType
    return F.lit(str(value)).cast(kind if isinstance(kind, (T.TimestampNTZType, T.DateType)) else "timestamp")


def seconds_between(start: Column, end: Column) -> Column:
    """Exact seconds as a double, by interval, so that no time zone enters."""
    return (end - start).cast("interval second").cast("decimal(24,6)").cast("double")


def plus_seconds(c: Column, seconds: Column) -> Column:
    return c + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def canonical_status(df: DataFrame) -> DataFrame:
    """Older status names read as the current ones."""
    s = F.col("processing_status")
    out = s
    for old, new in STATUS_SYNONYMS.items():
        out = F.when(s == old, new).otherwise(out)
    return df.withColumn("processing_status", out)


def in_period(df: DataFrame, start, end, column: str = "start_time") -> DataFrame:
    """Rows from start to end, both included; the filter reaches the scan."""
    return df.where(F.col(column).between(ts(start, df, column), ts(end, df, column)))


def scan_metrics_period(df: DataFrame, start, end) -> DataFrame:
    return in_period(df, start, end).orderBy(F.col("start_time").desc(), "document_id")


def recent_documents(df: DataFrame, start, end, n: int = 100) -> DataFrame:
    """Newest ``n`` documents with the total count of the period."""
    from foliant.operators.quantiles import attach

    period = in_period(df, start, end)
    total = period.agg(F.count(F.lit(1)).alias("total_count"))
    return attach(period.orderBy(F.col("start_time").desc(), "document_id").limit(n), total, [])


def parse_json_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """JSON text columns to MAP<STRING,DOUBLE>; NULL and bad text become an empty map."""
    empty = F.create_map().cast("map<string,double>")
    return df.withColumns({c: F.coalesce(F.from_json(c, "map<string,double>"), empty) for c in columns})


#: The columns of a metrics table; a stored one may lack some, and holds maps as JSON text.
METRICS = {
    "document_id": "string", "document_type": "string", "processing_status": "string", "start_time": "timestamp", "end_time": "timestamp",
    "total_processing_time": "double", "field_count": "int", "hitl_required": "boolean", "hitl_reason": "string", "exception_type": "string",
    "cost_breakdown": "map<string,double>", "confidence_scores": "map<string,double>", "created_at": "timestamp",
}


def as_metrics(rows: DataFrame) -> DataFrame:
    """Stored rows as metrics: current status names, maps read from JSON text, other types cast, missing columns NULL (false for
    ``hitl_required``). Columns that metrics do not have stay behind; ``dt`` stays for pruning."""
    have = dict(rows.dtypes)
    cols = []
    for name, kind in METRICS.items():
        if name not in have:
            c = F.create_map().cast(kind) if kind.startswith("map") else F.lit(None).cast(kind)
        elif kind.startswith("map") and have[name] == "string":
            c = F.coalesce(F.from_json(name, kind), F.create_map().cast(kind))
        elif kind == "timestamp" and have[name] == "timestamp_ntz":
            c = F.col(name)
        else:
            c = F.col(name).cast(kind)
        cols.append((F.coalesce(c, F.lit(False)) if name == "hitl_required" else c).alias(name))
    return canonical_status(rows.select(*cols, *[c for c in ("dt",) if c in have]))


def stored_metrics(table: VersionedTable | DataFrame, start=None, end=None) -> DataFrame:
    """A stored metrics table (by day in ``dt``) as metrics, for a period if one is given.

    Only the days of the period are read: folders of a versioned table are left out by name, and ``dt`` is a partition filter of
    any other.
    """
    first, last = (None if x is None else str(x)[:10] for x in (start, end))
    if isinstance(table, VersionedTable):
        rows = table.read(part=lambda day: day != NULL_PART and (first is None or day >= first) and (last is None or day <= last))
    else:
        rows = table
    if first is not None:
        rows = rows.where(F.col("dt") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("dt") <= F.lit(last).cast("date"))
    out = as_metrics(rows)
    if start is not None and end is not None:
        out = in_period(out, start, end)
    return out.drop("dt")


def derive_stage_times(df: DataFrame, total: str = "total_processing_time") -> DataFrame:
    t = F.col(total)
    return df.withColumns({"ocr_time": t * 0.4, "extraction_time": t * 0.3, "validation_time": t * 0.2})


def map_total(c: Column) -> Column:
    return F.aggregate(F.map_values(c), F.lit(0.0), lambda acc, x: acc + x)


def cost_part(c: Column, name: str) -> Column:
    """A cost component under its short or its long key."""
    return F.coalesce(F.try_element_at(c, F.lit(name)), F.try_element_at(c, F.lit(f"{name}_cost")), F.lit(0.0))
