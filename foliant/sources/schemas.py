"""Document schemas as data: JSON files or JSON text to a table of fields with defaults applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import config
from foliant.config import ColumnSpec, DocSchema, FieldSpec, TableSpec

_FIELD = ("struct<name:string,field_type:string,required:boolean,synonyms:array<string>,validation_rules:array<string>,"
          "default_value:string,confidence_threshold:double,description:string>")
_TABLE = ("struct<name:string,header_required:boolean,min_rows:int,max_rows:int,sum_columns:array<string>,"
          "columns:array<struct<name:string,field_type:string,required:boolean>>>")
SCHEMA_TYPE = (f"struct<template_type:string,version:string,required_confidence:double,fields:array<{_FIELD}>,"
               f"tables:array<{_TABLE}>,business_rules:array<string>>")


def parse_schemas(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON text per row to schema structs; text that is no schema is skipped."""
    s = texts.withColumn("schema", F.from_json(column, SCHEMA_TYPE)).drop(column)
    return s.where(F.col("schema.template_type").isNotNull())


def schema_field_rows(schemas: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per field, defaults filled in."""
    d = config.SCHEMA_DEFAULTS
    f = schemas.select(*keys, F.col("schema.template_type").alias("document_type"),
                       F.coalesce("schema.required_confidence", F.lit(d["required_confidence"])).alias("required_confidence"),
                       F.posexplode_outer("schema.fields").alias("pos", "f")).where(F.col("f").isNotNull())
    none = F.array().cast("array<string>")
    return f.select(*keys, "document_type", "required_confidence", "pos", F.col("f.name").alias("field_name"), F.col("f.field_type").alias("field_type"),
                    F.coalesce("f.required", F.lit(d["required"])).alias("required"), F.coalesce("f.synonyms", none).alias("synonyms"),
                    F.coalesce("f.validation_rules", none).alias("validation_rules"), F.col("f.default_value").alias("default_value"),
                    F.coalesce("f.confidence_threshold", F.lit(d["confidence_threshold"])).alias("confidence_threshold"))


def schema_table_rows(schemas: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    d = config.SCHEMA_DEFAULTS
    t = schemas.select(*keys, F.col("schema.template_type").alias("document_type"), F.explode_outer("schema.tables").alias("t")).where(F.col("t").isNotNull())
    return t.select(*keys, "document_type", F.col("t.name").alias("table_name"),
                    F.coalesce("t.header_required", F.lit(d["header_required"])).alias("header_required"),
                    F.coalesce("t.min_rows", F.lit(d["min_rows"])).alias("min_rows"), F.coalesce("t.max_rows", F.lit(d["max_rows"])).alias("max_rows"),
                    F.col("t.columns").alias("columns"))


def scan_schemas(spark: SparkSession, path: str) -> DataFrame:
    """Schema files of a folder, one JSON document per file; bad files are skipped."""
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return parse_schemas(texts)


def load_schemas(spark: SparkSession, path: str) -> dict[str, DocSchema]:
    """Schema files as the objects operators are compiled from: configuration that the program's plans are made of.

    Where schemas are data, any number of them, use the tables of ``scan_schemas`` and join.
    """
    rows = scan_schemas(spark, path).collect()
    d = config.SCHEMA_DEFAULTS
    pick = lambda v, name: d[name] if v is None else v
    out = {}
    for r in (row["schema"] for row in rows):
        fields = tuple(FieldSpec(f["name"], f["field_type"], pick(f["required"], "required"), pick(f["confidence_threshold"], "confidence_threshold"),
                                 tuple(f["synonyms"] or ()), tuple(f["validation_rules"] or ()), f["default_value"]) for f in r["fields"] or ())
        tables = tuple(TableSpec(t["name"], tuple(ColumnSpec(c["name"], c["field_type"]) for c in t["columns"] or ()), pick(t["min_rows"], "min_rows"),
                                 pick(t["max_rows"], "max_rows"), pick(t["header_required"], "header_required")) for t in r["tables"] or ())
        out[r["template_type"]] = DocSchema(r["template_type"], pick(r["required_confidence"], "required_confidence"), fields, tables, tuple(r["business_rules"] or ()))
    return out


def schema_lookup(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """Expected fields, synonyms and rules per requested document type; fallback lists where there is no schema."""
    per_type = fields.groupBy("document_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "field_name"))), lambda x: x["field_name"]).alias("names"))
    fallback = F.create_map(*[x for k, v in config.FALLBACK_FIELDS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    other = F.array(*[F.lit(n) for n in config.FALLBACK_DEFAULT])
    return requests.join(per_type, "document_type", "left").withColumn(
        "field_names", F.coalesce("names", F.try_element_at(fallback, F.col("document_type")), other)).drop("names")
