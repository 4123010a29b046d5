"""Candle sources: tumbling windows over events, raw OHLCV JSON, store scans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickflow.schemas import SERIES, TIMEFRAME_MS


def millis(ts: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp read as UTC, whatever the session's zone."""
    return F.expr(f"unix_millis(from_utc_timestamp(cast({ts} as timestamp), current_timezone()))")


def candles_from_events(events: DataFrame, timeframe: str = "1h", bot_id: str = "dev-bot") -> DataFrame:
    """OHLCV per event type and window: one partial and one final aggregation."""
    step = TIMEFRAME_MS[timeframe]
    order = F.struct("ms", "event_id")
    ticks = events.select(F.col("event_type").alias("pair"), millis("ts").alias("ms"), "event_id", "value").filter("value is not null and ms is not null")
    agg = ticks.groupBy("pair", (F.col("ms") - F.pmod("ms", F.lit(step))).alias("ts")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return agg.select(F.lit(bot_id).alias("bot_id"), "pair", F.lit(timeframe).alias("timeframe"), "ts", "open", "high", "low", "close", "volume")


def read_ohlcv_json(spark: SparkSession, path: str, pair: str, timeframe: str, bot_id: str = "dev-bot") -> DataFrame:
    """Candles of files that hold ``[[ts, o, h, l, c, v], ...]``."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<double>>")).alias("r"))
    return raw.select(F.lit(bot_id).alias("bot_id"), F.lit(pair).alias("pair"), F.lit(timeframe).alias("timeframe"), F.col("r")[0].cast("long").alias("ts"),
                      *[F.col("r")[k].alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume"), 1)])


def write_ohlcv_json(candles: DataFrame, path: str, files: int = 1) -> None:
    """Files of ``[[ts, o, h, l, c, v], ...]``, one array each, that ``read_ohlcv_json`` reads back.

    Rows go to ``files`` ranges of time and stream through sorted; the brackets
    come with the first and last row. A range without rows has no file.
    """
    values = F.array(*[F.col(c).cast("double") for c in ("ts", "open", "high", "low", "close", "volume")])
    lines = candles.repartitionByRange(files, "ts").sortWithinPartitions("ts").select(F.to_json(values, {"ignoreNullFields": "false"}).alias("value"))

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead = None, "["
        for b in batches:
            for line in b.column("value").to_pylist():
                if held is not None:
                    yield pa.RecordBatch.from_pydict({"value": [f"{lead}{held},"]})
                    lead = ""
                held = line
        if held is not None:
            yield pa.RecordBatch.from_pydict({"value": [f"{lead}{held}]"]})

    lines.mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def recent(candles: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest candles of each series. Spark keeps ``n`` per series and task
    before the shuffle (window group limit), so a long series doesn't move as a whole."""
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("ts")))
    return candles.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def since(candles: DataFrame, ts: int) -> DataFrame:
    return candles.filter(F.col("ts") >= ts)


def duration_seconds(text: str) -> int:
    """``7d``, ``1h`` or ``30m`` in seconds; anything else is an hour."""
    m = re.fullmatch(r"(\d+)([dhm])", text)
    return int(m[1]) * {"d": 86_400, "h": 3_600, "m": 60}[m[2]] if m else 3_600


def event_log(events: DataFrame, since_ts: int | None = None, levels: tuple[str, ...] = (), categories: tuple[str, ...] = (), limit: int | None = 100) -> DataFrame:
    """The log scan: only the predicates that are asked for, oldest first."""
    if since_ts is not None:
        events = events.filter(F.col("ts") >= since_ts)
    if levels:
        events = events.filter(F.col("level").isin(*levels))
    if categories:
        events = events.filter(F.col("category").isin(*categories))
    return events.orderBy("ts").limit(limit) if limit else events


def dedupe(candles: DataFrame) -> DataFrame:
    """One row per candle identity, for repeats that are equal; ``store.latest`` picks among versions."""
    return candles.dropDuplicates([*SERIES, "ts"])
