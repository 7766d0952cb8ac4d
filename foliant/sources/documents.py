"""Finding new documents: object listings and create events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CREATED = "Microsoft.Storage.BlobCreated"


def is_pdf(name: Column) -> Column:
    return F.lower(name).endswith(".pdf")


def scan_documents(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Files of a folder tree whose name ends in .pdf, whatever the case; contents only on request."""
    df = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    )
    cols = ["path", "modificationTime", "length", *(["content"] if content else [])]
    return df.where(is_pdf(F.col("path"))).select(*cols)


def keep_pdfs(listing: DataFrame, name: str = "path") -> DataFrame:
    return listing.where(is_pdf(F.col(name)))


def scan_new_documents(listing: DataFrame, processed: DataFrame, name: str = "path") -> DataFrame:
    """Names not yet in the processed table."""
    from foliant.operators.joins import anti_processed

    return anti_processed(keep_pdfs(listing, name), processed, name)


def scan_events(events: DataFrame, body: str = "body") -> DataFrame:
    """Create-events from JSON text: the last path part of the URL, if it names a PDF."""
    kind = "struct<eventType:string,subject:string,data:struct<url:string>>"
    e = events.withColumn("__e", F.from_json(body, kind)).where(F.col("__e.eventType") == CREATED)
    name = F.element_at(F.split(F.col("__e.data.url"), "/"), -1)
    return e.withColumn("name", name).where(is_pdf(F.col("name"))).drop("__e")
