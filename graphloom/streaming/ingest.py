"""Incremental mode: files of pages that arrive are chunked as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.chunking import window_chunks


def page_stream(spark: SparkSession, folder: str, schema: str = "doc_id BIGINT, text STRING", files: int = 100) -> DataFrame:
    """New Parquet files of a folder, ``files`` in a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def chunk_stream(pages: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Window chunks of each arriving text; no state is kept."""
    return window_chunks(pages, size, overlap)


def write_chunks(chunks: DataFrame, folder: str, checkpoint: str):
    """Append chunks to a folder; the checkpoint makes each file count once."""
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
