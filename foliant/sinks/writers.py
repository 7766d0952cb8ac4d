"""Writing results: upsert and append tables, JSON and CSV exports, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import written
from foliant.sinks.versioned import NULL_PART, VersionedTable

TEMPORARY_KEYS = ("temp_path", "preprocessed_path")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row per key; the rank filter is pushed below the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def merge_metrics(old: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Insert-or-replace as a frame; both sides have one row per key, and the fresh one wins.

    The old table is only filtered by the keys of the (usually far smaller) new rows; adaptive execution
    broadcasts those by size and then leaves the old table unshuffled.
    """
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_document_metrics(new: DataFrame, table: VersionedTable, key: str = "document_id", order: str = "created_at") -> None:
    """Merge new rows into a table that is partitioned by day; only the days that they touch are written anew, once.

    Of several new rows of a key the last written wins; it is kept once. Touched are its day and the day on which the document that
    it replaces stands now; a key column of the table is looked through for these, and no other column. The table changes
    when its new version is named, and not before.
    """
    base = table.version()
    fresh = latest(with_day(new), [key], [F.col(order).desc()])
    if not base.schema:
        table.replace(fresh, base=base)
        return
    fresh = written(fresh, "upsert")  # one row per key, read for the days and for the merge
    replaced = table.rows(base).join(fresh.select(key), key, "left_semi").select("dt")
    days = {NULL_PART if r["dt"] is None else str(r["dt"]) for r in replaced.union(fresh.select("dt")).distinct().collect()}  # days, however many rows
    touched = table.rows(base, lambda part: part in days)
    table.replace(merge_metrics(touched, fresh, key), gone=days, base=base)


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("dt", F.to_date("start_time"))


def append_field_metrics(df: DataFrame, path: str, batch: str) -> None:
    """Append a batch; the same batch once more replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def drop_temporary(df: DataFrame) -> DataFrame:
    """Removes temporary path keys from the stage structs."""
    kind = df.schema["stages"].dataType.elementType
    keep = [f.name for f in kind.fields if f.name not in TEMPORARY_KEYS]
    return df.withColumn("stages", F.transform("stages", lambda s: F.struct(*[s[n].alias(n) for n in keep])))


def sink_json(df: DataFrame, path: str) -> None:
    drop_temporary(df).write.mode("overwrite").json(path)


def batch_info(df: DataFrame, as_of) -> DataFrame:
    """A result has failed if its own entry says so, or any stage of it did."""
    failed = F.exists("stages", lambda s: s["status"] == "failed")
    return df.agg(F.count(F.lit(1)).alias("total_documents"), F.count_if(~failed).alias("successful"),
                  F.count_if(failed).alias("failed")).withColumn("timestamp", F.lit(str(as_of)))


def sink_batch_json(df: DataFrame, path: str, as_of) -> None:
    """Two outputs: the summary row and the results."""
    batch_info(df, as_of).write.mode("overwrite").json(f"{path}/batch_info")
    sink_json(df, f"{path}/results")


def flatten_csv(df: DataFrame, names: list[str]) -> DataFrame:
    """One wide row per result with the named fields, columns sorted by name; no shuffle, the map is read key by key.

    The names come from the schemas in use; an open set of names has the long form, ``sink_csv_long``.
    """
    data = F.col("extracted_data")
    wide = []
    for n in names:
        entry = F.try_element_at(data, F.lit(n))
        wide += [entry["value"].alias(f"field_{n}_value"), entry["confidence"].alias(f"field_{n}_confidence")]
    base = [c for c in df.columns if c not in ("stages", "extracted_data", "validation_results")]
    flat = df.select(*base, *wide)
    return flat.select(*sorted(flat.columns))


def sink_csv_flat(df: DataFrame, path: str, names: list[str]) -> None:
    flatten_csv(df, names).write.mode("overwrite").option("header", True).csv(path)


def sink_csv_long(df: DataFrame, path: str, keys: list[str]) -> None:
    """A line per result and field, for any number of field names."""
    long = df.select(*keys, F.explode("extracted_data").alias("field_name", "entry")).select(*keys, "field_name", "entry.value", "entry.confidence")
    long.write.mode("overwrite").option("header", True).csv(path)


def union_columns(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def save_snapshot(kpi: DataFrame, path: str, template_type: str, start, end) -> None:
    kpi.select(F.lit(template_type).alias("template_type"), F.lit(str(start)).cast("timestamp_ntz").alias("period_start"),
               F.lit(str(end)).cast("timestamp_ntz").alias("period_end"), F.struct(*kpi.columns).alias("kpis")).write.mode("append").parquet(path)


def export_training_data(records: DataFrame, path: str, document_type: str | None = None) -> None:
    """One JSON object per sample, written in parallel."""
    rows = records if document_type is None else records.where(F.col("document_type") == document_type)
    rows.write.mode("overwrite").json(path)
