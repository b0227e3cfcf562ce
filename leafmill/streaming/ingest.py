"""Incremental ingest: new documents are chunked once, by content, as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import audit_hash
from leafmill.operators.lines import packed


def document_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Parquet files of documents as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def chunk_stream(documents: DataFrame, key: str, text: str, at: str, late: str = "7 days") -> DataFrame:
    """(key, content_hash, at, piece_no, piece): each document version once.

    A version (key and content hash) that arrives again within `late` of event time is dropped
    by a watermarked deduplication, whose state is bounded by that time.
    """
    seen = documents.withColumn("content_hash", audit_hash(F.col(text))).withWatermark(at, late).dropDuplicatesWithinWatermark([key, "content_hash"])
    return seen.select(key, "content_hash", at, F.posexplode(packed(F.col(text))).alias("piece_no", "piece"))


def arrivals(documents: DataFrame, at: str, group: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, group, n): documents per event-time window, closed once no later ones may come."""
    return documents.withWatermark(at, late).groupBy(F.window(at, window), group).agg(F.count(F.lit(1)).alias("n"))


def write_chunks(stream: DataFrame, path: str, checkpoint: str):
    """Appends the chunks to a Parquet table and stops when all present files are done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
