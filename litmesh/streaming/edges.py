"""Streams of candidate edges, merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litmesh.operators.edges import by_rank, with_confidence


def merged_stream(edges: DataFrame) -> DataFrame:
    """Merged edges of a stream, for update or complete mode: maxima and sets may be taken in any order and again, so late and repeated rows change nothing they should not."""
    e = with_confidence(edges).where("from_key is not null and to_key is not null and from_key <> to_key")
    out = e.groupBy("from_key", "to_key").agg(F.max("confidence").alias("confidence"), F.collect_set("via").alias("via"))
    return out.select("from_key", "to_key", "confidence", by_rank(F.col("via")).alias("via"))


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def upsert(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a merged edge table at `path`: each batch is merged by itself, then appended as a version that `current` folds.

    Appending partial merges keeps every batch's cost in proportion to the batch; no batch rewrites the table.
    """

    def batch(df: DataFrame, number: int) -> None:
        merged_stream(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(df: DataFrame) -> DataFrame:
    """The merged edges of all batches of an `upsert` table."""
    return df.groupBy("from_key", "to_key").agg(F.max("confidence").alias("confidence"), by_rank(F.array_distinct(F.flatten(F.collect_set("via")))).alias("via"))
