"""What the operators share: reading tables, tables kept in the shared folder, fixed character classes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import work_path

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the folder that all executors share and read it back.

    This cuts the lineage: the rows, and ids made from their place, are the same ones for every later
    job even when executors are lost, and the planner knows the table's real size.
    """
    path = work_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty.

    ``lower`` does the same, and faster, where every character is one byte.
    """
    t = F.coalesce(text, F.lit(""))
    slow = F.translate(t, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(slow)


def n_words(text: Column) -> Column:
    """Number of words, as long; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
