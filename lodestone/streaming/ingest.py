"""Extension: streaming forms of ingestion and of event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import preprocess as P


def chunk_stream(documents: DataFrame, *, most: int = P.MAX_SIZE, overlap: int = P.OVERLAP) -> DataFrame:
    """Chunks of a stream of documents(id, content): stateless, by size."""
    return P.chunk_by_size(documents, most=most, overlap=overlap)


def upserts(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch to `apply(batch, epoch)` once; equal epochs after a restart must be idempotent there."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, *, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window start, event_type, n, total value; rows later than `late` are dropped by the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session start and end, n."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, key: str, *, late: str = "10 minutes") -> DataFrame:
    """Rows whose key has not come within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
