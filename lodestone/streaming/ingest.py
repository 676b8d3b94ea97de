"""Structured Streaming: extracted rows arrive as files and are merged into keyed tables; events are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.entities import clean_entities, upsert_nodes


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def merge_nodes(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Node counts after a batch: state and batch have the same keys, so they meet in one aggregate."""
    new = upsert_nodes(clean_entities(batch)).select("label", "name", "created_at", "n_rows")
    rows = new if state is None else state.unionByName(new)
    return rows.groupBy("label", "name").agg(F.min("created_at").alias("created_at"), F.sum("n_rows").alias("n_rows"))


def node_stream(entities: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the node table of a stream: every batch writes a new version beside the old one, then points to it.

    A batch that is repeated after a failure starts from the version before it, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/version={number - 1}") if number else None
        merge_nodes(before, batch).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return entities.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and value sums of events by window and type; rows later than the watermark are dropped by Spark."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = F.window("at", size, slide) if slide else F.window("at", size)
    out = at.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: events closer than the gap belong together."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = at.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
