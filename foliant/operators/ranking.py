"""Row numbers over groups of any size: range partitions plus offsets instead of one sorted task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialize


def row_numbers(df: DataFrame, group_cols: list[str], order_cols: list[str], name: str = "rn",
                partitions: int | None = None) -> DataFrame:
    """1-based row number per group in the given order, which must be total.

    Rows are split by range on group and order, so a hot group spans many partitions. The split is
    kept in the checkpoint folder, each partition numbers its own rows, and the count of the rows
    before it is added.
    """
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = materialize(
        df.repartitionByRange(n, *group_cols, *order_cols).withColumn("__pid", F.spark_partition_id())
    )
    counts = parts.groupBy("__pid", *group_cols).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    inside = Window.partitionBy("__pid", *group_cols).orderBy(*order_cols)
    return (
        parts.withColumn("__rn", F.row_number().over(inside))
        .join(offsets, ["__pid", *group_cols])
        .withColumn(name, (F.col("__off") + F.col("__rn")).cast("long"))
        .drop("__pid", "__rn", "__off")
    )
