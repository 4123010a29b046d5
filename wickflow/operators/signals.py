"""The signal pipeline: regime, trend, pattern, confidence, volume, then the signal."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.functions.candle import geometry, session, session_confidence_multiplier
from wickflow.operators import gates, memory
from wickflow.operators.frames import FRAME
from wickflow.operators.indicators import CHUNK_ROWS, chunks, framed, indicators, keys, window_ranges
from wickflow.operators.patterns import REGISTRY, detect
from wickflow.params import Params
from wickflow.schemas import SERIES
from wickflow.scratch import materialise


def reason_text(params: Params = Params()) -> Column:
    """The first rejection's reason with its values, of evaluated rows that kept ``best``; null for fired ones."""
    least = F.lit(params.min_confidence) * session_confidence_multiplier(session(F.col("ts")))
    return F.when(F.col("reason") == "volume_ratio_below_threshold", F.format_string("volume_ratio_below_threshold:%.3f<%.3f", "volume_ratio", "volume_threshold")).when(
        F.col("reason") == "confidence_below_min", F.format_string("confidence_below_min:%.3f<%.3f", "best.confidence", least)).otherwise(F.col("reason"))


def enrich(candles: DataFrame, params: Params = Params(), buffer: int = FRAME) -> DataFrame:
    """Candles with geometry and stored indicators."""
    return indicators(geometry(candles), params, buffer)


def enrich_framed(candles: DataFrame, params: Params = Params(), buffer: int = FRAME, window: int = FRAME) -> DataFrame:
    """``enrich`` with the evaluation's frame columns from the same pass, for series that are not split afterwards."""
    return framed(geometry(candles), params, buffer, window)


def with_frames(enriched: DataFrame, params: Params = Params(), lags: bool = True) -> DataFrame:
    """The evaluation's frame columns, unless the rows have them."""
    return enriched if "streak_n" in enriched.columns else window_ranges(enriched, params=params, lags=lags)


def labelled(enriched: DataFrame, params: Params = Params()) -> DataFrame:
    """Enriched candles with the regime; QUIET is stored as null."""
    out = gates.regime(with_frames(enriched, params, lags=False), params)
    return out.withColumn("regime", F.when(F.col("regime") != "QUIET", F.col("regime")))


def scan(df: DataFrame, params: Params = Params(), pattern_memory: DataFrame | None = None) -> DataFrame:
    """Add ``best``: the permitted candidate along the trend with the highest final confidence.

    ``pattern_memory`` (pattern, direction, sample_count, win_rate) adjusts and
    suppresses; the scan looks it up by pattern and direction.
    """
    if pattern_memory is not None:
        # Patterns x directions: a handful of rows, read as one map per run.
        rows = pattern_memory.select(F.concat_ws(":", "pattern", "direction").alias("k"), F.struct("sample_count", "win_rate").alias("v"))
        df = df.crossJoin(F.broadcast(rows.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__m"))))
    return df.withColumn("best", _best(tuple(REGISTRY), "__m" in df.columns)).drop("__m")


@lru_cache(maxsize=64)
def _best(names: tuple[str, ...], remembered: bool) -> Column:
    """The candidate of highest confidence among the detectors' columns, of equals the first registered; with memory from the map ``__m``."""
    factor, found = session_confidence_multiplier(session(F.col("ts"))), []
    for k, name in enumerate(names):
        hit = F.col(f"p_{name}")
        conf, skip = hit["confidence"], F.lit(False)
        if remembered:
            m = F.try_element_at(F.col("__m"), F.concat(F.lit(f"{name}:"), F.col("trend")))
            conf, skip = memory.adjust(conf, m["sample_count"], m["win_rate"]), memory.suppressed(m["sample_count"], m["win_rate"])
        ok = hit.isNotNull() & (hit["direction"] == F.col("trend")) & gates.permitted(name) & ~skip
        found.append(F.when(ok, F.struct(F.round(conf / factor, 3).alias("confidence"), F.lit(-k).alias("order"), F.lit(name).alias("pattern"), hit["direction"].alias("direction"))))
    return F.array_max(F.array_compact(F.array(*found)))


def evaluate(enriched: DataFrame, params: Params = Params(), pattern_memory: DataFrame | None = None, keep_best: bool = False) -> DataFrame:
    """One row per candle: a fired signal or the first rejection.

    A pure function of the evaluation window, so all candles are evaluated at
    once; frames stay inside a ``fold`` where the input has one.
    """
    return judge(with_frames(enriched, params), params, pattern_memory, keep_best)


def judge(df: DataFrame, params: Params = Params(), pattern_memory: DataFrame | None = None, keep_best: bool = False) -> DataFrame:
    """``evaluate`` of rows with their frame columns: projections only, on a stream too."""
    return _fired(scan(_detected(df, params), params, pattern_memory), params, keep_best)


def _detected(df: DataFrame, params: Params) -> DataFrame:
    return detect(gates.volume(gates.trend(gates.regime(df, params), params), params), params)


def evaluate_at_time(enriched: DataFrame, trades: DataFrame, params: Params = Params(), keep_best: bool = False) -> DataFrame:
    """``evaluate`` with the memory that each candle could have: of trades closed before it, by pattern and direction.

    Only candidates along the trend ask the memory, a few of all candles.
    ``keep_best`` leaves the scan's choice, fired or not, in ``best``.
    """
    df = materialise(_detected(with_frames(enriched, params), params), "detected")
    series = [*keys(df), "ts"]
    hits = F.array(*[F.when(F.col(f"p_{name}")["direction"] == F.col("trend"), F.lit(name)) for name in REGISTRY])
    asked = df.select(*series, F.col("trend").alias("direction"), F.explode(F.array_compact(hits)).alias("pattern"))
    met = memory.at_time(asked, trades)
    entry = F.struct(F.concat_ws(":", "pattern", "direction").alias("k"), F.struct("sample_count", "win_rate").alias("v"))
    # At most one entry for each detector.
    known = met.groupBy(*series).agg(F.map_from_entries(F.collect_list(entry)).alias("__m"))
    return _fired(scan(df.join(known, series, "left"), params), params, keep_best)


def _fired(df: DataFrame, params: Params, keep_best: bool = False) -> DataFrame:
    reject, made = _verdict(params)
    return df.withColumn("reject", reject).withColumns(made).drop("reject", *([] if keep_best else ["best"]))


@lru_cache(maxsize=64)
def _verdict(params: Params) -> tuple[Column, dict[str, Column]]:
    """The first rejection (stage, reason), and the signal's columns."""
    why = lambda stage, reason: F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))
    least = F.lit(params.min_confidence) * session_confidence_multiplier(session(F.col("ts")))
    conf = F.col("best.confidence")
    first = F.when(F.col("regime_reject").isNotNull(), why("regime", F.col("regime_reject"))).when(F.col("trend_reject").isNotNull(), why("trend", F.col("trend_reject"))).when(
        F.col("best").isNull(), why("pattern", F.lit("no_pattern_fired"))).when(conf < least, why("pattern", F.lit("confidence_below_min"))).when(
        F.col("volume_reject").isNotNull(), why("volume", F.col("volume_reject"))).when(F.coalesce(F.col("atr14"), F.lit(0.0)) == 0, why("pattern", F.lit("atr_unavailable")))
    sign = F.when(F.col("best.direction") == "long", 1.0).otherwise(-1.0)
    fired = F.col("reject").isNull()
    level = lambda m: F.when(fired, F.round(F.col("close") + sign * F.col("atr14") * m, 8))
    return first, {
        "outcome": F.when(fired, "fired").otherwise("rejected"), "stage": F.col("reject.stage"), "reason": F.col("reject.reason"),
        "pattern": F.when(fired, F.col("best.pattern")), "side": F.when(fired, F.col("best.direction")), "confidence": F.when(fired, conf),
        "entry_price": F.when(fired, F.round("close", 8)), "tp_price": level(params.tp_atr_multiplier), "sl_price": level(-params.sl_atr_multiplier),
        "size_usdt": F.when(fired, F.when(conf >= 0.75, 10.0).otherwise(5.0)),
    }


def evaluate_chunked(candles: DataFrame, params: Params = Params(), rows: int = CHUNK_ROWS) -> DataFrame:
    """``evaluate`` of raw candles whose series are cut into chunks of about ``rows`` rows.

    A chunk brings the rows before it that two frames and the lags need, so
    results are those of the whole series, in as many tasks as there are chunks.
    """
    out = evaluate(enrich_framed(chunks(candles, 2 * FRAME + 20, rows), params), params)
    return out.filter("own").drop("own", "chunk", "rn", "n")


def evaluate_candles(candles: DataFrame, params: Params = Params(), rows: int = CHUNK_ROWS) -> DataFrame:
    """``evaluate`` of raw candles; where a series holds more than ``rows``, all are cut into chunks."""
    candles = materialise(candles, "candles")
    longest = candles.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    return evaluate_chunked(candles, params, rows) if longest > rows else evaluate(enrich_framed(candles, params), params).drop("rn", "n")


def probe(evaluated: DataFrame, last: int | None = None) -> DataFrame:
    """Counts of outcomes by stage and reason with their share."""
    from pyspark.sql import Window

    if last is not None:
        rank = F.row_number().over(Window.partitionBy("bot_id", "pair", "timeframe").orderBy(F.desc("ts")))
        evaluated = evaluated.withColumn("__r", rank).filter(F.col("__r") <= last)
    counts = evaluated.groupBy(F.coalesce("stage", F.lit("fired")).alias("stage"), F.coalesce("reason", F.lit("fired")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))
