"""Trades, heartbeats and log rows made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.functions.candle import session
from wickflow.schemas import HOUR_MS
from wickflow.sources.candles import millis


def trades_from_orders(orders: DataFrame) -> DataFrame:
    """A deterministic trade per order; orders of status O are open positions."""
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    done = F.col("o_orderstatus") != "O"
    start = F.col("d") + key % 24 * HOUR_MS
    df = orders.withColumn("d", millis("o_orderdate")).select(
        key.alias("trade_id"), F.lit("dev-bot").alias("bot_id"), F.lit("dev").alias("env"), F.col("o_orderpriority").alias("pair"), F.lit("1h").alias("timeframe"),
        F.when(cust % 2 == 0, "long").otherwise("short").alias("direction"),
        F.when(cust % 3 == 0, "wick_rejection").when(cust % 3 == 1, "anomaly_fade").otherwise("impulse_retracement").alias("pattern"),
        start.alias("entry_ts"), price.alias("entry_price"), F.when(done, start + (F.lit(1) + cust % 48) * HOUR_MS).alias("exit_ts"),
        F.when(done, (price - 150000.0) / 10000.0).alias("pnl_net_usdt"), F.when(done, (price - 150000.0) / 1000.0).alias("pnl_pct"),
        F.when(done, (F.lit(1) + cust % 48).cast("int")).alias("hold_candles"),
        F.when(done, F.when(key % 4 == 0, "take_profit").when(key % 4 == 1, "stop_loss").when(key % 4 == 2, "timeout")).alias("close_reason"))
    return df.withColumn("session", session(F.col("entry_ts"))).withColumn(
        "regime", F.when(F.col("trade_id") % 3 == 0, "TRENDING").when(F.col("trade_id") % 3 == 1, "RANGING").otherwise("VOLATILE"))


def heartbeats_from_events(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("bot-"), (F.col("user_id") % 10).cast("string")).alias("bot_id"), millis("ts").alias("ts"),
                         F.col("event_id").cast("int").alias("pid"), F.col("event_type").alias("status"))


def log_from_events(events: DataFrame) -> DataFrame:
    return events.select("event_id", millis("ts").alias("ts"), F.col("event_type").alias("category"),
                         F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("props").alias("payload"))
