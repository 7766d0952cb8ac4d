"""Session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: A number of partitions that document rows are dealt to before heavy work in the row. Where it is not set, rows with a key are dealt by it to
#: TASKS_PER_CORE tasks per core, and rows without one stay where they are read. Nothing looks at the data's size.
INPUT_CONF = "spark.foliant.inputPartitions"


TASKS_PER_CORE = 4


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows, batch or stream, dealt to tasks alike.

    A table of narrow rows is packed so densely that a file part of the usual size has millions of them, and a part without the start of a
    row group has none: heavy work in the row then keeps a few cores busy and leaves the others idle.
    """
    n = int(df.sparkSession.conf.get(INPUT_CONF, "0"))
    if key is None:
        return df.repartition(n) if n else df
    return df.repartition(n or TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, key)


def local_session(cpus: int = 8, name: str = "foliant", memory: str = "8g", input_partitions: int = 0) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config(INPUT_CONF, str(input_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach; a temporary one only where none is named and all run on this machine (tests)."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"name a folder that all executors share in {CHECKPOINT_CONF}")
        path = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for tables a job writes for itself."""
    return os.path.join(shared_dir(spark), f"foliant-{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder, so lost executors cannot change the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """A frame written to the shared folder and read back: cut lineage, and later reads take only the columns they need."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
