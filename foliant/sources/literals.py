"""Small configuration tables as VALUES relations, whose size the planner knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, list | tuple):
        return f"array({', '.join(map(sql_value, v))})"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows known to the program as a frame; ``schema`` as ``name type, ...`` without commas inside a type."""
    columns = [c.split() for c in schema.split(",")]
    casts = ", ".join(f"cast({name} as {kind}) as {name}" for name, kind in columns)
    names = ", ".join(name for name, _ in columns)
    if not rows:
        return spark.sql(f"select {casts} from values ({', '.join(['null'] * len(columns))}) as t({names}) where false")
    values = ", ".join(f"({', '.join(map(sql_value, r))})" for r in rows)
    return spark.sql(f"select {casts} from values {values} as t({names})")
