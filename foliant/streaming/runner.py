"""Running streaming queries to the end of what is there, with restartable outputs."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import work_path
from foliant.sinks.versioned import LeveledLog

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def read_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1000) -> DataFrame:
    """A parquet table as a file stream; ``max_files`` bounds a micro-batch."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", max_files).parquet(sf_dir)
    )


def batch_writer(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; a batch that is run again overwrites its own folder, so results are exactly-once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> None:
    """Processes everything available and stops; give a fixed checkpoint to continue later."""
    checkpoint = checkpoint or work_path(df.sparkSession, "stream")
    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 30, mode: str = "append"):
    """The same as a continuous job with a processing-time trigger."""
    return (df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(processingTime=f"{seconds} seconds").start())


def latest_per(table: DataFrame, keys: list[str], keep_batch: bool = False) -> DataFrame:
    """The rows of the last micro-batch that wrote each key, for outputs in update mode."""
    cols = [c for c in table.columns if c not in keys and (keep_batch or c != "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("v")).select(*keys, "v.*")


def log_writer(log: LeveledLog) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for outputs in update mode: rows carry the number of their batch."""
    return lambda batch, batch_id: log.append(batch.withColumn("batch", F.lit(batch_id)), batch_id)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB: a key is looked up by its sorted files' filters, and a micro-batch
    uploads what it changed, whatever the size of the state."""
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STATE_STORE) if before is None else spark.conf.set(_STATE_STORE, before)
