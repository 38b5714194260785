"""Streams of events: windowed counts with late data, and counters kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", key: str = "event_type", ts: str = "ts") -> DataFrame:
    """(start, end, key, n): events later than `late` are dropped, by the watermark."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return grouped.select("window.start", "window.end", key, "n")


def next_user_edges(events: DataFrame) -> DataFrame:
    """Static events -> edges (src, dst) between users of consecutive events of a type.  In a
    stream use keep_next_edges, which carries the last event over the borders of batches."""
    from ..sources.star import with_next

    return with_next(events, "event_type", ["ts", "event_id"], "user_id").where("__next IS NOT NULL").select(F.col("user_id").alias("src"), F.col("__next").alias("dst"))


def keep_next_edges(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the edges of each micro-batch once, named by batch.  The last event of each type
    is kept beside them and comes before the next batch, so no edge is lost at its border;
    events are taken to arrive in order of batches."""
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("event_type", "ts", "event_id", "user_id")
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{path}/last/batch={number - 1}").select(rows.columns))
        next_user_edges(rows).write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
        last = rows.groupBy("event_type").agg(F.max(F.struct("ts", "event_id", "user_id")).alias("x"))
        last.select("event_type", "x.*").write.mode("overwrite").parquet(f"{path}/last/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_counters(events: DataFrame, path: str, checkpoint: str, key: str = "user_id") -> StreamingQuery:
    """Writes each micro-batch's deltas (id, value) once, named by batch, so a batch that is
    run again after a failure replaces its own files; `counters` sums them."""
    def write(batch: DataFrame, number: int) -> None:
        deltas = batch.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("value"))
        deltas.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("id").agg(F.sum("value").cast("long").alias("value"))
