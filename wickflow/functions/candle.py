"""Scalar functions on candles: geometry, sessions, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.schemas import DAY_MS, HOUR_MS

#: Fees and slippage in percent of a side, and risk constants.
TAKER_FEE = 0.0004
SLIPPAGE = 0.0005
MAINTENANCE = 0.005
ROUND_TRIP_PCT = 0.04 + 0.04 + 0.05 + 0.05


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or a constant where b is not above zero."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def geometry(df: DataFrame) -> DataFrame:
    """Body, range, wicks and direction; stored values win over recomputed ones."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    made = {
        "body_size": F.abs(c - o), "total_range": h - low, "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - low,
        "direction": F.when(c >= o, "bullish").otherwise("bearish"),
    }
    out = df.withColumns({k: F.coalesce(F.col(k), v) if k in df.columns else v for k, v in made.items()})
    body = ratio(F.col("body_size"), F.col("total_range"))
    return out.withColumn("body_ratio", F.coalesce(F.col("body_ratio"), body) if "body_ratio" in df.columns else body)


def side() -> Column:
    """long or short, by a candle's stored direction."""
    return F.when(F.col("direction") == "bullish", "long").otherwise("short")


def session(ts: Column) -> Column:
    """Trading session of the UTC hour."""
    hour = F.pmod(F.floor(ts / HOUR_MS), F.lit(24))
    return F.when((hour >= 13) & (hour < 16), "overlap").when((hour >= 8) & (hour < 13), "london").when((hour >= 16) & (hour < 21), "us").otherwise("asian")


def session_volume_multiplier(s: Column) -> Column:
    return F.when(s == "asian", 1.2).when(s == "london", 1.0).otherwise(0.9)


def session_confidence_multiplier(s: Column) -> Column:
    return F.when(s == "asian", 1.1).otherwise(1.0)


def midnight(ts: Column) -> Column:
    return ts - F.pmod(ts, F.lit(DAY_MS))


def liquidation_price(entry: Column, direction: Column, leverage: int, maintenance: float = MAINTENANCE) -> Column:
    long, short = 1.0 - 1.0 / leverage + maintenance, 1.0 + 1.0 / leverage - maintenance
    return entry * F.when(direction == "long", F.lit(long)).otherwise(F.lit(short))
