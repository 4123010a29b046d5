"""Tunable parameters and run configuration, validated on the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Strategy parameters; the defaults are the production values."""

    ema_fast: int = 9
    ema_slow: int = 21
    rsi_low: float = 45.0
    rsi_high: float = 55.0
    rsi_long_max: float = 75.0
    rsi_short_min: float = 25.0
    volume_ratio_min: float = 1.3
    tp_atr_multiplier: float = 1.6
    sl_atr_multiplier: float = 1.0
    min_confidence: float = 0.55
    adx_trend_min: float = 25.0
    bb_width_threshold: float = 0.02
    max_hold_candles: int = 4
    max_active_buckets: int = 1
    body_ratio_min: float = 0.55
    wick_ratio_min: float = 2.0
    compression_factor: float = 0.4
    ema_spread_threshold: float = 0.001
    atr_volatile_multiplier: float = 1.5
    atr_quiet_multiplier: float = 0.35
    retracement_min: float = 0.3
    retracement_max: float = 0.5
    anomaly_volume_stddev: float = 2.0
    anomaly_price_atr: float = 2.0
    momentum_acceleration_candles: int = 2

    def largest(self, name: str) -> int:
        """The parameter where a plan's shape needs a number: a frame's length, a count of lags."""
        return getattr(self, name)

    def values(self, name: str) -> tuple:
        return (getattr(self, name),)

    @classmethod
    def from_dict(cls, raw: Mapping) -> Params:
        """From ``{name: {"value": v}}`` or ``{name: v}``; names every missing key at once."""
        missing = [f.name for f in fields(cls) if f.name not in raw]
        if missing:
            raise ValueError("missing parameters: " + ", ".join(missing))
        plain = {f.name: raw[f.name]["value"] if isinstance(raw[f.name], Mapping) else raw[f.name] for f in fields(cls)}
        return cls(**{f.name: (int if f.type == "int" else float)(plain[f.name]) for f in fields(cls)})

    @classmethod
    def from_json(cls, text: str) -> Params:
        return cls.from_dict(json.loads(text))

    def changed(self, name: str, value: str | float) -> Params:
        """A copy with one parameter cast to its type and checked against its range."""
        kind = {f.name: f.type for f in fields(self)}.get(name)
        if kind is None:
            raise ValueError(f"unknown parameter {name}")
        cast = (int if kind == "int" else float)(value)
        low, high = RANGES[name]
        if not low <= cast <= high:
            raise ValueError(f"{name}={cast} is outside [{low}, {high}]")
        return replace(self, **{name: cast})


@dataclass(frozen=True)
class ColumnParams:
    """Parameters that rows bring along: each attribute is a column, so gates and detectors read them as they read numbers.

    ``sets`` are all that may occur; where a plan's shape depends on a parameter
    it is made for the largest, or for each distinct value.
    """

    sets: tuple[Params, ...]

    def __getattr__(self, name: str) -> Column:
        if name not in NAMES:
            raise AttributeError(name)
        return F.col(f"p_{name}")

    def largest(self, name: str) -> int:
        return max(getattr(s, name) for s in self.sets)

    def values(self, name: str) -> tuple:
        return tuple(sorted({getattr(s, name) for s in self.sets}))


NAMES = tuple(f.name for f in fields(Params))
#: Tuning ranges.
RANGES = {
    "ema_fast": (5, 20), "ema_slow": (15, 50), "rsi_low": (30.0, 55.0), "rsi_high": (45.0, 70.0), "rsi_long_max": (60.0, 90.0),
    "rsi_short_min": (10.0, 40.0), "volume_ratio_min": (1.1, 2.5), "tp_atr_multiplier": (0.8, 3.0), "sl_atr_multiplier": (0.5, 2.0),
    "min_confidence": (0.4, 0.8), "adx_trend_min": (15.0, 30.0), "bb_width_threshold": (0.01, 0.05), "max_hold_candles": (2, 8),
    "max_active_buckets": (1, 5), "body_ratio_min": (0.4, 0.8), "wick_ratio_min": (1.5, 4.0), "compression_factor": (0.3, 0.7),
    "ema_spread_threshold": (0.0005, 0.005), "atr_volatile_multiplier": (1.2, 2.5), "atr_quiet_multiplier": (0.3, 0.7),
    "retracement_min": (0.2, 0.5), "retracement_max": (0.3, 0.7), "anomaly_volume_stddev": (1.5, 4.0), "anomaly_price_atr": (1.5, 4.0),
    "momentum_acceleration_candles": (2, 5),
}


@dataclass(frozen=True)
class RunConfig:
    """What a run needs besides the parameters."""

    bot_id: str = "dev-bot"
    session_id: str = "session"
    env: str = "dev"
    leverage: int = 20
    max_active_buckets: int = 1
    log_level: str = "INFO"
    telegram_enabled: bool = False

    @classmethod
    def from_mapping(cls, raw: Mapping[str, str]) -> RunConfig:
        missing = [k for k in ("BOT_ID", "ENV") if not raw.get(k)]
        if missing:
            raise ValueError("missing settings: " + ", ".join(missing))
        if raw["ENV"].lower() not in ("dev", "prod"):
            raise ValueError(f"ENV must be dev or prod, not {raw['ENV']}")
        return cls(bot_id=raw["BOT_ID"], env=raw["ENV"].lower(), session_id=raw.get("SESSION_ID", "session"), leverage=int(raw.get("LEVERAGE", 20)),
                   max_active_buckets=int(raw.get("MAX_ACTIVE_BUCKETS", 1)), log_level=raw.get("LOG_LEVEL", "INFO").upper(),
                   telegram_enabled=raw.get("TELEGRAM_ENABLED", "").lower() in ("1", "true", "yes"))
