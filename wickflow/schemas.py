"""Schemas of the store and its fixed domains."""

from __future__ import annotations

CANDLE = ("bot_id string, pair string, timeframe string, ts bigint, open double, high double, low double, close double, volume double")
TRADE = ("trade_id bigint, bot_id string, env string, pair string, timeframe string, direction string, pattern string, entry_ts bigint, entry_price double, "
         "tp_price double, sl_price double, liquidation_price double, size_usdt double, leverage int, exit_ts bigint, exit_price double, hold_candles int, "
         "pnl_gross_usdt double, pnl_net_usdt double, pnl_pct double, close_reason string")
HEARTBEAT = "bot_id string, ts bigint, pid int, status string, note string"
OPS_EVENT = "bot_id string, session_id string, env string, ts bigint, level string, category string, message string, payload string, trade_id bigint"

#: String domains.
DOMAINS = {
    "env": ("dev", "prod"), "direction": ("long", "short"), "regime": ("TRENDING", "VOLATILE", "RANGING", "QUIET"),
    "outcome": ("fired", "rejected", "expired"), "close_reason": ("take_profit", "stop_loss", "timeout", "liquidated", "manual"),
    "session": ("asian", "london", "us", "overlap"),
}

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
#: Columns that identify a series, and one candle with ``ts``.
SERIES = ("bot_id", "pair", "timeframe")
TIMEFRAME_MS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": HOUR_MS, "4h": 4 * HOUR_MS, "1d": DAY_MS}
