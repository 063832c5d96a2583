"""Windowed counts over an event stream; the same functions serve batch frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..sources.tables import exists


def stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A file stream of Parquet events with ``ts`` as a zoned timestamp, which watermarks need."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str | None = None, key: str = "event_type") -> DataFrame:
    """Counts and sums per event type, or another key, and day; ``late`` is how long a day stays open for late events."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", "1 day"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sliding(events: DataFrame, size: str = "7 days", slide: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums per event type of overlapping windows, which begin a ``slide`` apart; ``size`` is a multiple of it.

    An event is counted once, in its pane, a tumbling window as long as the slide; only panes, a row for each type and slide, are copied
    into the windows that hold them. As a stream both steps run in append mode: a window comes out when the watermark has passed its end."""
    events = events.withWatermark("ts", late) if late else events
    panes = events.groupBy(F.window("ts", slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.min("value").alias("low"), F.max("value").alias("high"))
    merged = panes.groupBy(F.window(F.window_time("window"), size, slide), "event_type")
    return merged.agg(F.sum("n").alias("n"), F.sum("value").alias("value"), F.min("low").alias("low"), F.max("high").alias("high"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Sessions of each user: events no more than ``gap`` apart."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def run_available(events: DataFrame, late: str) -> DataFrame:
    """The daily counts of a stream, run over the files there are, from a table in the shared folder.

    Each batch writes the days that it changed, and the last version of a day counts. In this output mode the watermark
    acts: a day that it has passed leaves the state, and events that come for it later are dropped."""
    spark = events.sparkSession
    at = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    shape = "start timestamp, event_type string, n bigint, value double, batch bigint"

    def keep(batch: DataFrame, number: int) -> None:
        changed = batch.select("window.start", "event_type", "n", "value", F.lit(number).cast("long").alias("batch"))
        changed.write.mode("overwrite").parquet(f"{at}/out/{number:09d}")

    query = daily(events, late).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not exists(spark, f"{at}/out"):
        return spark.createDataFrame([], shape).drop("batch")
    versions = spark.read.schema(shape).option("recursiveFileLookup", True).parquet(f"{at}/out")
    return versions.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("value", "batch").alias("value"))
