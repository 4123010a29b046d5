"""Risk gates. Row-local rules are projections; capacity and daily loss need the
state of the position fold and are applied there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wickflow.functions.candle import ROUND_TRIP_PCT, liquidation_price

#: Limits.
MIN_LIQUIDATION_DISTANCE = 0.015
MIN_REWARD_RISK = 1.2
FEE_MULTIPLE = 1.5
DAILY_LOSS = -5.0
STALE_SECONDS = 60


def row_reason(entry: Column, tp: Column, sl: Column, direction: Column, leverage: int) -> Column:
    """The first of the row-local rules that fails, in order; null: none."""
    distance = F.abs(entry - liquidation_price(entry, direction, leverage)) / F.when(entry != 0, entry)
    gain, loss = F.abs(tp - entry), F.abs(sl - entry)
    return F.when(distance < MIN_LIQUIDATION_DISTANCE, "liquidation_too_close").when(loss == 0, "sl_distance_zero").when(
        gain / F.when(loss != 0, loss) < MIN_REWARD_RISK, "rr_below_minimum").when(
        gain / F.when(entry != 0, entry) * 100.0 <= ROUND_TRIP_PCT * FEE_MULTIPLE, "fee_not_viable")


def reason(entry: Column, tp: Column, sl: Column, direction: Column, leverage: int, active: Column, session_pnl: Column, since_reconnect_ms: Column, max_active: int = 1) -> Column:
    """All six rules, for rows that carry their state."""
    return F.when(active >= max_active, "bucket_limit").otherwise(F.coalesce(
        row_reason(entry, tp, sl, direction, leverage), F.when(session_pnl <= DAILY_LOSS, "daily_loss_limit"),
        F.when(since_reconnect_ms / 1000.0 < STALE_SECONDS, "stale_data")))
