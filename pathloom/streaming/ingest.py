"""Ingestion of a stream of documents: chunks of each micro-batch are merged into a Parquet table.

An extension over the batch engine.  A batch that is delivered again after a
failure gives the same table, as chunks are keyed by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.chunking import chunk_all


def ingest_stream(docs: DataFrame, methods: tuple[str, ...], folder: str, checkpoint: str) -> StreamingQuery:
    """``docs``: a streaming (filename, text).  Each batch is written under its own number, so a rerun replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_all(batch, methods).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(chunks: DataFrame) -> DataFrame:
    """Of each chunk id the row of the latest batch."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    return chunks.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("chunk_id", "r.*")
