"""Streaming candles.

Closed candles come from tumbling windows under a watermark (append mode), so a
late tick can't reopen a candle. ``trading`` goes on from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wickflow.schemas import TIMEFRAME_MS

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Events as a stream; the trigger's file count bounds a batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def closed_candles(events: DataFrame, timeframe: str = "1h", delay: str = "10 minutes", bot_id: str = "dev-bot") -> DataFrame:
    """OHLCV of closed windows; ticks repeated within the watermark count once."""
    ticks = events.withColumn("at", F.expr("from_utc_timestamp(cast(ts as timestamp), current_timezone())")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])
    order = F.struct("at", "event_id")
    agg = ticks.groupBy(F.col("event_type").alias("pair"), F.window("at", f"{TIMEFRAME_MS[timeframe] // 1000} seconds").alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return agg.select(F.lit(bot_id).alias("bot_id"), "pair", F.lit(timeframe).alias("timeframe"), F.unix_millis("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def to_files(candles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed candles to Parquet files, exactly once; ends when the input is used up."""
    return candles.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
