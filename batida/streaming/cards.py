"""Extraction over a stream of pages. An extension: both layouts are stateless, so each page is handled as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from batida.model import CARD_PAGES
from batida.operators.layouts import extract


def read_pages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Pages (doc_id, page_no, text) from Parquet files as they arrive."""
    return spark.readStream.schema(CARD_PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def extract_stream(spark: SparkSession, source: str, target: str, checkpoint: str, layout: str):
    """Starts a query that appends punch records to Parquet files in target; it ends when all files present are done."""
    rows = extract(read_pages(spark, source), layout)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
