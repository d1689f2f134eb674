"""Panels from streams (an addition): windowed sums of events with a watermark, appended once complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_panel(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(series_id, start, volume, mean_value) of tumbling windows; rows later than ``late`` are dropped by the watermark.

    A row without a time or kind belongs to no window. Works on a stream or a table.
    """
    stamped = events.where(F.col(time).isNotNull() & F.col(kind).isNotNull()).withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    rows = stamped.groupBy(F.window("_at", width), kind).agg(F.count(F.lit(1)).cast("double").alias("volume"), F.avg(value).alias("mean_value"))
    return rows.select(F.concat(F.lit("events:"), kind).alias("series_id"), F.col("window.start").alias("start"), "volume", "mean_value")


def append_panel(events: DataFrame, folder: str, checkpoint: str, **options) -> None:
    """Run a stream of events to its present end, adding finished windows to a table in ``folder``."""
    rows = stream_panel(events, **options)
    query = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
