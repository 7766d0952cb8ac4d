"""Streams of documents: each name once, and the document plan per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.documents import metrics_rows, process_documents
from foliant.sources.documents import is_pdf


def document_files(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """New PDF files of a folder tree as a stream of path, time and length."""
    df = (spark.readStream.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true")
          .option("maxFilesPerTrigger", max_files).load(path))
    return df.where(is_pdf(F.col("path"))).select("path", "modificationTime", "length")


def once(names: DataFrame, name: str) -> DataFrame:
    """Names never seen before, whatever their age; to be run inside ``rocksdb_state``.

    Each name is a key of the state, dealt to a fixed number of partitions by hash. A micro-batch looks up its own names, by
    filters over sorted files, and reads nothing that earlier batches wrote. Names are kept for ever: there is no watermark.
    """
    return names.dropDuplicates([name])


def stream_documents(docs: DataFrame, as_of, compat: bool = False) -> DataFrame:
    """Extraction, validation and routing of a stream of recognised documents, as metric rows; no state, no shuffle."""
    return metrics_rows(process_documents(docs, as_of, compat=compat))


def current_metrics(table: DataFrame) -> DataFrame:
    """The last written row per document of a batch-partitioned metrics table."""
    from foliant.streaming.runner import latest_per

    return latest_per(table, ["document_id"])
