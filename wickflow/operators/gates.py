"""Gates: market regime, trend with streak, volume; each yields a label or a rejection reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.functions.candle import session, session_volume_multiplier
from wickflow.operators.indicators import frame
from wickflow.params import Params

#: Patterns that each regime allows.
ALLOWED = {
    "TRENDING": ("impulse_retracement", "momentum_continuation"),
    "VOLATILE": ("compression_breakout", "anomaly_fade"),
    "RANGING": ("wick_rejection", "anomaly_fade"),
    "QUIET": (),
}
#: What the overlap session allows.
OVERLAP_ALLOWED = ("compression_breakout",)


def regime(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Add ``regime`` (QUIET included) and ``regime_reject``; needs ``window_ranges``."""
    atr14, atr50 = F.col("atr14"), F.coalesce(F.col("atr50_w"), F.col("atr14"))
    spread = F.when(F.col("ema21") != 0, F.abs(F.col("ema9") - F.col("ema21")) / F.when(F.col("ema21") != 0, F.col("ema21"))).otherwise(0.0)
    quiet = (atr14 < atr50 * params.atr_quiet_multiplier) | (F.coalesce(F.col("volume_ratio"), F.lit(1.0)) < 0.7)
    label = F.when(F.col("n") < 2, F.lit(None)).when(quiet, "QUIET").when(
        (atr14 > atr50 * params.atr_volatile_multiplier) & (F.col("adx") > 15.0), "VOLATILE").when(
        (F.col("adx") > params.adx_trend_min) & (spread > params.ema_spread_threshold), "TRENDING").otherwise("RANGING")
    return df.withColumn("regime", label).withColumn("ema_spread", spread).withColumn(
        "regime_reject", F.when(F.col("n") < 2, "insufficient_candles").when(F.col("regime") == "QUIET", "quiet_regime"))


def trend(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Add ``trend`` (long or short, before the streak test), ``streak_ok`` and ``trend_reject``."""
    fast, slow, r = F.col("ema9"), F.col("ema21"), F.col("rsi14")
    way = F.when((fast > slow) & r.between(params.rsi_low, params.rsi_long_max), "long").when(
        (fast < slow) & r.between(params.rsi_short_min, params.rsi_high), "short")
    df = df.withColumn("trend", way)
    if "streak_n" not in df.columns:
        prior = frame(df, 3, -1)
        known = F.when(fast.isNotNull() & slow.isNotNull(), F.when(fast > slow, 1).when(fast < slow, -1).otherwise(0))
        df = df.withColumn("k", known).withColumns({"streak_lo": F.min("k").over(prior), "streak_hi": F.max("k").over(prior), "streak_n": F.count("k").over(prior)}).drop("k")
    agree = F.when(F.col("trend") == "long", F.col("streak_lo") == 1).when(F.col("trend") == "short", F.col("streak_hi") == -1)
    df = df.withColumn("streak_ok", (F.col("n") < 4) | (F.col("streak_n") < 2) | F.coalesce(agree, F.lit(False)))
    reject = F.when(F.col("n") < params.ema_slow + 1, "insufficient_candles").when(F.col("trend").isNull(), "no_trend_alignment").when(~F.col("streak_ok"), "no_trend_streak")
    return df.withColumn("trend_reject", reject).drop("streak_lo", "streak_hi", "streak_n")


def volume(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Add ``volume_threshold`` and ``volume_reject``."""
    threshold = F.lit(params.volume_ratio_min) * session_volume_multiplier(session(F.col("ts")))
    return df.withColumn("volume_threshold", threshold).withColumn("volume_reject", F.when(
        F.col("volume_ratio").isNull() | F.col("volume_ma20").isNull(), "volume_indicators_missing").when(
        F.col("volume_ratio") < F.col("volume_threshold"), "volume_ratio_below_threshold"))


def permitted(name: str) -> Column:
    """Whether regime and session allow a pattern."""
    by_regime = F.col("regime").isin(*[r for r, names in ALLOWED.items() if name in names])
    return by_regime & ((session(F.col("ts")) != "overlap") | F.lit(name in OVERLAP_ALLOWED))
