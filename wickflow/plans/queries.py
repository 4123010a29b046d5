"""The engine's registered queries, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickflow.functions import messages
from wickflow.functions.candle import geometry, liquidation_price, session, session_confidence_multiplier, session_volume_multiplier
from wickflow.operators import backtest, gates, memory, metrics, repair, risk, signals, store, trials, versions
from wickflow.operators.indicators import indicators, moves
from wickflow.operators.patterns import detect
from wickflow.params import Params
from wickflow.plans import sql
from wickflow.plans.adapters import heartbeats_from_events, log_from_events, trades_from_orders
from wickflow.schemas import DAY_MS, HOUR_MS
from wickflow.scratch import materialise, scratch_uri, ship
from wickflow.sources.candles import candles_from_events, dedupe, event_log, read_ohlcv_json, recent, since, write_ohlcv_json
from wickflow.sources.pages import CandlePages, write_pages
from wickflow.streaming import candles as stream
from wickflow.streaming import trading

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PARAMS = Params()
#: A looser variant for the tuning query.
LOOSE = Params(body_ratio_min=0.4, min_confidence=0.4, adx_trend_min=15.0, volume_ratio_min=1.1)
#: Fixed instants in the tables' ranges.
JAN_10 = 1_704_844_800_000
MAR_1996 = 825_638_400_000


#: Trades by day of exit, for the SQL of the reports.
_DAYS = """, d AS (SELECT exit_ts - exit_ts % 86400000 AS day_ts, count(*) AS trades, count(*) FILTER (WHERE pnl_net_usdt > 0) AS wins, sum(pnl_net_usdt) AS pnl, count(*) FILTER (WHERE pnl_net_usdt > 0)::DOUBLE / count(*) AS win_rate
  FROM closed GROUP BY 1),
day AS (SELECT *, (SELECT count(*) FROM trades x WHERE x.entry_ts < day_ts + 86400000 AND coalesce(x.exit_ts >= day_ts + 86400000, true)) AS active FROM d)"""


def _add(twin: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if twin is not None:
            SQL[f.__name__] = twin
        return f

    return wrap


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _candles(spark: SparkSession, d: str) -> DataFrame:
    return candles_from_events(_read(spark, d, "events"))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return signals.enrich(_candles(spark, d))


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    return signals.enrich_framed(_candles(spark, d))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return gates.volume(gates.trend(gates.regime(_windowed(spark, d))))


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return trades_from_orders(_read(spark, d, "orders"))


def _closed(spark: SparkSession, d: str) -> DataFrame:
    return _trades(spark, d).filter(F.col("exit_ts").isNotNull())


def _r8(*columns: str) -> list:
    return [F.round(c, 8).alias(c.split(".")[-1]) for c in columns]


@_add(sql.query(sql.CANDLES, "SELECT pair, ts, open, high, low, close, volume FROM candles"))
def candles_1h(spark, d):
    return _candles(spark, d).select("pair", "ts", "open", "high", "low", "close", "volume")


_GEO = ("body_size", "total_range", "body_ratio", "upper_wick", "lower_wick")


@_add(sql.query(sql.GEOMETRY, f"SELECT pair, ts, {sql.r8(*_GEO)}, direction FROM geo"))
def geometry_columns(spark, d):
    return geometry(_candles(spark, d)).select("pair", "ts", *_r8(*_GEO), "direction")


@_add(sql.query(sql.GEOMETRY, """SELECT pair, ts, session, (CASE session WHEN 'asian' THEN 1.2 WHEN 'london' THEN 1.0 ELSE 0.9 END)::DOUBLE AS volume_multiplier,
(CASE session WHEN 'asian' THEN 1.1 ELSE 1.0 END)::DOUBLE AS confidence_multiplier, ts - ts % 86400000 AS midnight_ts FROM geo"""))
def session_tag(spark, d):
    s = session(F.col("ts"))
    return _candles(spark, d).select("pair", "ts", s.alias("session"), session_volume_multiplier(s).alias("volume_multiplier"),
                                     session_confidence_multiplier(s).alias("confidence_multiplier"), (F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).alias("midnight_ts"))


@_add(sql.query(sql.CANDLES, """SELECT pair, ts, round(close * (1 - 1.0::DOUBLE / 20 + 0.005::DOUBLE), 8) AS long_liquidation,
round(close * (1 + 1.0::DOUBLE / 20 - 0.005::DOUBLE), 8) AS short_liquidation, round(0.04::DOUBLE + 0.04::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE, 8) AS round_trip_fee_pct FROM candles"""))
def liquidation_levels(spark, d):
    return _candles(spark, d).select("pair", "ts", F.round(liquidation_price(F.col("close"), F.lit("long"), 20), 8).alias("long_liquidation"),
                                     F.round(liquidation_price(F.col("close"), F.lit("short"), 20), 8).alias("short_liquidation"), F.round(F.lit(0.04) + 0.04 + 0.05 + 0.05, 8).alias("round_trip_fee_pct"))


@_add(sql.query(sql.INDICATORS, f"SELECT pair, ts, {sql.r8('ema9', 'ema21')}, ema9 > ema21 AS uptrend FROM ind"))
def ema_cross(spark, d):
    return indicators(_candles(spark, d), only=("ema9", "ema21")).select("pair", "ts", *_r8("ema9", "ema21"), (F.col("ema9") > F.col("ema21")).alias("uptrend"))


def _indicator(name: str, *columns: str, source=None) -> None:
    def f(spark, d):
        df = source(spark, d) if source else indicators(_candles(spark, d), only=columns)
        return df.select("pair", "ts", *_r8(*columns))

    f.__name__ = name
    _add(sql.query(sql.INDICATORS, f"SELECT pair, ts, {sql.r8(*columns)} FROM ind"))(f)


_indicator("rsi14", "rsi14")
_indicator("bollinger", "bb_upper", "bb_lower", "bb_width")
_indicator("true_range", "tr", "up", "down", source=_windowed)
_indicator("atr14", "atr14")
_indicator("atr50", "atr50_w", source=_windowed)
_indicator("atr5_atr20", "tr5", "tr20", source=_windowed)
_indicator("adx14", "adx")
_indicator("volume_stats", "volume_ma20", "volume_sd20", "volume_ratio")
_indicator("all_indicators", "ema9", "ema21", "rsi14", "atr14", "bb_upper", "bb_lower", "bb_width", "adx", "volume_ma20", "volume_ratio")


@_add(sql.query(sql.INDICATORS, f"SELECT pair, ts, {sql.r8(*repair.NAMES)} FROM ind"))
def fill_indicators(spark, d):
    """Stored candles with gaps: single values, all of an hour, a stretch of days; only their frames are computed again."""
    held, hour = materialise(_enriched(spark, d), "stored-candles"), F.floor(F.col("ts") / HOUR_MS)
    lost = (hour % 211 == 0) | (F.col("pair") == "error") & F.col("ts").between(JAN_10, JAN_10 + 2 * DAY_MS)
    gaps = {c: F.when(~lost & ~((hour % 97 == 0) & F.lit(c in ("adx", "ema9"))), F.col(c)) for c in repair.NAMES}
    return repair.fill_missing(materialise(held.withColumns(gaps), "gaps")).select("pair", "ts", *_r8(*repair.NAMES))


@_add(sql.query(sql.GATES, "SELECT pair, ts, regime, regime_reject FROM gate"))
def regime_label(spark, d):
    return _gated(spark, d).select("pair", "ts", "regime", "regime_reject")


@_add(sql.query(sql.GATES, """, h AS (SELECT coalesce(CASE WHEN regime <> 'QUIET' THEN regime END, 'None') AS regime, count(*) AS n FROM gate GROUP BY 1)
SELECT regime, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 8) AS pct FROM h"""))
def regime_histogram(spark, d):
    return store.histogram(signals.labelled(_windowed(spark, d)), "regime").select("regime", "n", *_r8("pct"))


@_add(sql.query(sql.GATES, "SELECT pair, ts, trend FROM gate"))
def trend_filter(spark, d):
    return _gated(spark, d).select("pair", "ts", "trend")


@_add(sql.query(sql.GATES, "SELECT pair, ts, streak_ok, trend_reject FROM gate"))
def trend_streak(spark, d):
    return _gated(spark, d).select("pair", "ts", "streak_ok", "trend_reject")


@_add(sql.query(sql.GATES, f"SELECT pair, ts, {sql.r8('volume_threshold')}, volume_reject FROM gate"))
def volume_confirm(spark, d):
    return _gated(spark, d).select("pair", "ts", *_r8("volume_threshold"), "volume_reject")


def _detector(short: str, name: str) -> None:
    def f(spark, d):
        hit = F.col(f"p_{name}")
        return detect(_windowed(spark, d), PARAMS, (name,)).select("pair", "ts", hit.isNotNull().alias("fired"), hit["direction"].alias("direction"), hit["confidence"].alias("confidence"))

    f.__name__ = f"pat_{short}"
    _add(sql.query(sql.PATTERNS, f"SELECT pair, ts, d_{short} IS NOT NULL AS fired, d_{short} AS direction, c_{short} AS confidence FROM det"))(f)


for _short, _name, _ in sql.DETECTORS:
    _detector(_short, _name)


@_add(sql.query(sql.SIGNALS, "SELECT pair, ts, best.pattern AS pattern, best.direction AS direction, best.confidence AS confidence FROM scn"))
def pattern_scan(spark, d):
    df = signals.scan(detect(_gated(spark, d)))
    return df.select("pair", "ts", F.col("best.pattern").alias("pattern"), F.col("best.direction").alias("direction"), F.col("best.confidence").alias("confidence"))


@_add(sql.query(sql.SIGNALS, "SELECT pair, ts, outcome, stage, reason, pattern, side, confidence, tp_price, sl_price, size_usdt FROM sig"))
def evaluate_signals(spark, d):
    return signals.evaluate_candles(_candles(spark, d)).select("pair", "ts", "outcome", "stage", "reason", "pattern", "side", "confidence", "tp_price", "sl_price", "size_usdt")


@_add(sql.query(sql.SIGNALS, """, c AS (SELECT coalesce(stage, 'fired') AS stage, coalesce(reason, 'fired') AS reason, count(*) AS n FROM sig WHERE rn > 60 GROUP BY 1, 2)
SELECT stage, reason, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 8) AS pct FROM c"""))
def reject_breakdown(spark, d):
    return signals.probe(signals.evaluate(_windowed(spark, d)).filter("rn > 60")).select("stage", "reason", "n", *_r8("pct"))


@_add(sql.query(sql.SIGNALS, """SELECT pair, ts, stage, CASE reason WHEN 'volume_ratio_below_threshold' THEN printf('volume_ratio_below_threshold:%.3f<%.3f', volume_ratio, volume_threshold)
WHEN 'confidence_below_min' THEN printf('confidence_below_min:%.3f<%.3f', best.confidence, 0.55::DOUBLE * (CASE WHEN session = 'asian' THEN 1.1 ELSE 1.0 END)::DOUBLE) ELSE reason END AS reason FROM sig WHERE outcome = 'rejected'"""))
def reject_reasons(spark, d):
    """Rejections with the values that decided."""
    df = signals.evaluate(_windowed(spark, d), keep_best=True).filter("outcome = 'rejected'")
    return df.select("pair", "ts", "stage", signals.reason_text().alias("reason"))


@_add(sql.query(sql.signals(LOOSE), "SELECT pattern, side AS direction, count(*) AS n FROM sig WHERE outcome = 'fired' GROUP BY 1, 2"))
def fired_patterns(spark, d):
    """Fired signals by pattern and direction."""
    fired = signals.evaluate(_windowed(spark, d), LOOSE).filter("outcome = 'fired'")
    return store.top(fired.select("pattern", F.col("side").alias("direction")), ["pattern", "direction"])


@_add(sql.query(sql.GATES, """, l AS (SELECT pair, coalesce(CASE WHEN regime <> 'QUIET' THEN regime END, 'None') AS regime FROM gate QUALIFY row_number() OVER (PARTITION BY pair ORDER BY ts DESC) <= 500),
h AS (SELECT regime, count(*) AS n FROM l GROUP BY 1) SELECT regime, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 8) AS pct FROM h"""))
def recent_regimes(spark, d):
    """Regimes of the last 500 candles of each pair."""
    return store.histogram(recent(signals.labelled(_windowed(spark, d)), 500), "regime").select("regime", "n", *_r8("pct"))


@_add(sql.query(sql.PATTERNS, """, u AS (SELECT pair, ts, 'impulse_retracement' AS pattern, unnest([{'k': 'trigger_body_ratio', 'v': round(body_ratio_1, 3)}, {'k': 'trigger_vol_ratio', 'v': round(volume_ratio_1, 3)}, {'k': 'retrace_frac', 'v': round(share, 3)}]) AS x FROM det WHERE d_impulse IS NOT NULL
UNION ALL SELECT pair, ts, 'wick_rejection', unnest([{'k': 'wick_ratio', 'v': round(CASE WHEN d_wick = 'long' THEN lw ELSE uw END, 3)}, {'k': 'close_position', 'v': round(place, 3)},
  {'k': 'level', 'v': round(CASE WHEN d_wick = 'long' THEN low10 ELSE high10 END, 2)}]) FROM det WHERE d_wick IS NOT NULL
UNION ALL SELECT pair, ts, 'momentum_continuation', unnest([{'k': 'setup_candles', 'v': 2.0::DOUBLE}, {'k': 'body_growth', 'v': round(growth, 3)}, {'k': 'retrace_body_ratio', 'v': round(body_size / body_size_1, 3)}]) FROM det WHERE d_momentum IS NOT NULL
UNION ALL SELECT pair, ts, 'anomaly_fade', unnest([{'k': 'spike_vol_ratio', 'v': round(times, 3)}, {'k': 'spike_move_atr', 'v': round(abs(close_1 - open_1) / atr14_prev, 3)}]) FROM det WHERE d_anomaly IS NOT NULL
UNION ALL SELECT pair, ts, 'compression_breakout', unnest([{'k': 'atr5_atr20_ratio', 'v': round(tr5 / tr20, 3)}, {'k': 'vol_ratio', 'v': round(volume_ratio, 3)}, {'k': 'bb_upper', 'v': round(bb_upper, 2)}, {'k': 'bb_lower', 'v': round(bb_lower, 2)}]) FROM det WHERE d_compression IS NOT NULL)
SELECT pair, ts, pattern, x.k AS detail, x.v AS value FROM u"""))
def pattern_details(spark, d):
    """The rounded details of every hit."""
    df = detect(_windowed(spark, d))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"p_{n}")["details"].alias("details")) for _, n, _ in sql.DETECTORS])).alias("h")
    return df.select("pair", "ts", each).filter("h.details is not null").select("pair", "ts", "h.pattern", F.explode("h.details").alias("detail", "value"))


@_add(sql.query(sql.INDICATORS, """, e AS (SELECT *, close + atr14 * 1.6::DOUBLE AS tp, close - atr14 AS sl, close * 1.0005::DOUBLE * (1 - 1.0::DOUBLE / 20 + 0.005::DOUBLE) AS liq,
  list({'ts': ts, 'c': close}) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM ind),
m AS (SELECT *, list_filter(list_transform(coalesce(ahead, []), lambda b: {'ts': b.ts, 'why': CASE WHEN b.c >= tp THEN 'take_profit' WHEN b.c <= sl THEN 'stop_loss' WHEN b.c <= liq THEN 'liquidated' END}),
  lambda b: b.why IS NOT NULL) AS met FROM e)
SELECT pair, ts, CASE WHEN len(met) > 0 THEN met[1].why ELSE 'timeout' END AS close_reason,
  CASE WHEN len(met) > 0 THEN met[1].ts WHEN len(coalesce(ahead, [])) > 0 THEN ahead[-1].ts ELSE ts END AS exit_ts FROM m"""))
def close_price_exits(spark, d):
    """Exits by closing prices alone, every candle taken as a long entry."""
    return _long_exits(spark, d, "close")


@_add(sql.query(sql.INDICATORS, """, lv AS (SELECT pair, ts, close, close + atr14 * 1.6::DOUBLE AS tp, close - atr14 * 1.0::DOUBLE AS sl, close * (1 - 1.0::DOUBLE / 20 + 0.005::DOUBLE) AS liq FROM ind)
SELECT pair, ts, CASE WHEN ts // 3600000 % 7 = 0 THEN 'bucket_limit' ELSE CASE WHEN abs(close - liq) / nullif(close, 0) < 0.015::DOUBLE THEN 'liquidation_too_close' WHEN abs(sl - close) = 0 THEN 'sl_distance_zero'
  WHEN abs(tp - close) / abs(sl - close) < 1.2::DOUBLE THEN 'rr_below_minimum' WHEN abs(tp - close) / nullif(close, 0) * 100 <= (0.04::DOUBLE + 0.04::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE) * 1.5::DOUBLE THEN 'fee_not_viable'
  WHEN ts // 3600000 % 11 >= 10 THEN 'daily_loss_limit' WHEN ts // 3600000 % 50 = 0 THEN 'stale_data' END END AS reason FROM lv"""))
def risk_gates(spark, d):
    """Every candle taken as a long entry, beside a state that changes by the hour."""
    c, a = F.col("close"), F.col("atr14")
    hour = F.floor(F.col("ts") / HOUR_MS)
    since_reconnect = F.when(hour % 50 == 0, 30_000)
    active, lost = F.when(hour % 7 == 0, 1).otherwise(0), -0.5 * (hour % 11)
    return _enriched(spark, d).select("pair", "ts", risk.reason(c, c + a * PARAMS.tp_atr_multiplier, c - a * PARAMS.sl_atr_multiplier, F.lit("long"), 20, active, lost, since_reconnect).alias("reason"))


@_add(sql.query(sql.INDICATORS, """, e AS (SELECT *, close + atr14 * 1.6::DOUBLE AS tp, close - atr14 AS sl, close * 1.0005::DOUBLE * (1 - 1.0::DOUBLE / 20 + 0.005::DOUBLE) AS liq,
  list({'ts': ts, 'h': high, 'l': low}) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM ind),
m AS (SELECT *, list_filter(list_transform(coalesce(ahead, []), lambda b: {'ts': b.ts, 'why': CASE WHEN b.h >= tp THEN 'take_profit' WHEN b.l <= sl THEN 'stop_loss' WHEN b.l <= liq THEN 'liquidated' END}),
  lambda b: b.why IS NOT NULL) AS met FROM e)
SELECT pair, ts, CASE WHEN len(met) > 0 THEN met[1].why ELSE 'timeout' END AS close_reason,
  CASE WHEN len(met) > 0 THEN met[1].ts WHEN len(coalesce(ahead, [])) > 0 THEN ahead[-1].ts ELSE ts END AS exit_ts FROM m"""))
def trade_exits(spark, d):
    """Every candle taken as a long entry."""
    return _long_exits(spark, d, "intrabar")


def _long_exits(spark: SparkSession, d: str, exit_mode: str) -> DataFrame:
    df = moves(_enriched(spark, d)).withColumns({"side": F.lit("long"), "tp_price": F.col("close") + F.col("atr14") * 1.6, "sl_price": F.col("close") - F.col("atr14")})
    df = df.withColumn("liquidation_price", liquidation_price(F.col("close") * 1.0005, F.col("side"), 20))
    return backtest.exits(df, exit_mode=exit_mode).select("pair", "ts", "close_reason", "exit_ts")


_TRADE = ("confidence", "entry_price", "tp_price", "sl_price", "liquidation_price", "size_usdt", "notional_usdt", "fee_entry_usdt", "exit_price", "fee_exit_usdt", "bucket_balance_after")
_MONEY = ("pnl_gross_usdt", "pnl_net_usdt", "pnl_pct")


@_add(sql.query(sql.simulation(LOOSE), """SELECT pair, side AS direction, pattern, ts AS entry_ts, exit_ts, close_reason, forced, CAST(greatest((exit_ts - ts) // 900000, 1) AS INTEGER) AS hold_candles,
confidence, round(fill, 6) AS entry_price, round(tp_price, 6) AS tp_price, round(sl_price, 6) AS sl_price, round(liquidation_price, 6) AS liquidation_price, size_usdt, round(notional, 6) AS notional_usdt,
round(fee, 6) AS fee_entry_usdt, round(price, 6) AS exit_price, round(fee, 6) AS fee_exit_usdt, round(10 + net, 4) AS bucket_balance_after, round(gross, 5) AS pnl_gross_usdt, round(net, 5) AS pnl_net_usdt,
round(net / size_usdt * 100, 4) AS pnl_pct FROM fate WHERE taken"""))
def backtest_trades(spark, d):
    """Sequential occupancy; tested against a row-by-row simulator too."""
    t = backtest.trades(backtest.backtest(_windowed(spark, d), LOOSE))
    return t.select("pair", "direction", "pattern", "entry_ts", "exit_ts", "close_reason", "forced", "hold_candles", *[F.round(c, 6).alias(c) for c in _TRADE], *[F.round(c, 4 if c == "pnl_pct" else 5).alias(c) for c in _MONEY])


@_add(sql.query(sql.simulation(LOOSE), """SELECT pair, ts, CASE WHEN outcome = 'fired' AND (risk_reason IS NOT NULL OR NOT coalesce(taken, false)) THEN 'rejected' ELSE outcome END AS outcome,
CASE WHEN outcome = 'fired' THEN CASE WHEN risk_reason IS NOT NULL OR NOT coalesce(taken, false) THEN 'risk' END ELSE stage END AS stage,
CASE WHEN outcome = 'fired' THEN coalesce(risk_reason, CASE WHEN NOT coalesce(taken, false) THEN 'daily_loss_limit' END) ELSE reason END AS reason,
CASE WHEN risk_reason IS NULL AND taken THEN pattern END AS pattern, CASE WHEN risk_reason IS NULL AND taken THEN side END AS direction, CASE WHEN risk_reason IS NULL AND taken THEN confidence END AS confidence
FROM fate WHERE NOT held"""))
def backtest_signal_log(spark, d):
    return backtest.signal_log(backtest.backtest(_windowed(spark, d), LOOSE)).drop("bot_id", "timeframe")


_PLACES = {"profit_factor": 3, "sharpe_ratio": 3, "avg_hold_candles": 2}


@_add(f"SELECT pair, fold, total_trades, win_count, loss_count, {', '.join(f'round({c}, {_PLACES.get(c, 4)}) AS {c}' for c in (*sql.FILLED, 'profit_factor'))} FROM ({sql.walk_forward(LOOSE)})")
def walk_forward_metrics(spark, d):
    run = backtest.walk_forward(_enriched(spark, d), LOOSE)
    groups = run.select("pair", "fold").distinct()
    return metrics.report(metrics.summary(backtest.trades(run), ["pair", "fold"], ["exit_ts", "entry_ts"], groups))


#: What the tuning query tries against the parameters as they are.
TRIED = PARAMS.changed("adx_trend_min", 15.0).changed("body_ratio_min", 0.4)


@_add(f"WITH b AS (SELECT * FROM ({sql.walk_forward(PARAMS)}) WHERE fold = 'out_sample'), c AS (SELECT * FROM ({sql.walk_forward(TRIED)}) WHERE fold = 'out_sample'),{sql.compared('b', 'c')}\n"
      "SELECT pair, metric, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, result, verdict FROM judged")
def tune_grid(spark, d):
    """Baseline against candidate on the out-of-sample fold, verdict per pair and metric."""
    base = materialise(_enriched(spark, d), "tuning-candles")
    out = []
    for p in (PARAMS, TRIED):
        run = backtest.walk_forward(base, p)
        out.append(metrics.summary(backtest.trades(run), ["pair", "fold"], ["exit_ts", "entry_ts"], run.select("pair", "fold").distinct()).filter("fold = 'out_sample'"))
    judged = metrics.compare(out[0], out[1], ["pair"])
    return judged.withColumns({c: F.round(c, 6) for c in ("baseline", "candidate")})


#: Sets that are tried at once; gates, detectors, exits and levels all differ.
TRIALS = {"baseline": PARAMS, "wide": TRIED, "patient": LOOSE.changed("max_hold_candles", 6).changed("tp_atr_multiplier", 2.0), "strict": LOOSE.changed("min_confidence", 0.6).changed("sl_atr_multiplier", 0.8)}


@_add(sql.trials(TRIALS))
def tune_trials(spark, d):
    """All sets in one plan; verdict and kept set per pair and trial."""
    judged = trials.judge_trials(_enriched(spark, d), TRIALS)
    return judged.select("pair", "trial", "metric", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate")], "result", "verdict", "kept")


_MET = ("win_rate", "total_pnl_usdt", "avg_pnl_usdt", "avg_win_usdt", "avg_loss_usdt", "avg_hold_candles", "profit_factor", "sharpe_ratio", "max_drawdown_usdt", "max_drawdown_pct")


def _summary(spark, d):
    return metrics.summary(_closed(spark, d), ["pair"], ["exit_ts", "trade_id"])


@_add(sql.query(sql.TRADES, "SELECT pair, total_trades, win_count, loss_count, round(win_rate, 8) AS win_rate, round(total_pnl_usdt, 6) AS total_pnl_usdt, round(avg_win_usdt, 8) AS avg_win_usdt, "
                "round(avg_loss_usdt, 8) AS avg_loss_usdt, round(profit_factor, 8) AS profit_factor, round(avg_hold_candles, 8) AS avg_hold_candles FROM met"))
def metrics_basic(spark, d):
    return _summary(spark, d).select("pair", "total_trades", "win_count", "loss_count", *_r8("win_rate"), F.round("total_pnl_usdt", 6).alias("total_pnl_usdt"), *_r8("avg_win_usdt", "avg_loss_usdt", "profit_factor", "avg_hold_candles"))


@_add(sql.query(sql.TRADES, "SELECT pair, round(sharpe_ratio, 6) AS sharpe_ratio FROM met"))
def sharpe(spark, d):
    return _summary(spark, d).select("pair", F.round("sharpe_ratio", 6).alias("sharpe_ratio"))


@_add(sql.query(sql.TRADES, "SELECT pair, round(max_drawdown_usdt, 6) AS max_drawdown_usdt, round(max_drawdown_pct, 6) AS max_drawdown_pct FROM met"))
def max_drawdown(spark, d):
    return _summary(spark, d).select("pair", F.round("max_drawdown_usdt", 6).alias("max_drawdown_usdt"), F.round("max_drawdown_pct", 6).alias("max_drawdown_pct"))


@_add(sql.query(sql.TRADES, "SELECT pair, trade_id, round(equity, 6) AS equity, round(peak - equity, 6) AS drawdown FROM dd"))
def equity_curve(spark, d):
    return metrics.drawdowns(_closed(spark, d), ["pair"], ["exit_ts", "trade_id"]).select("pair", "trade_id", F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


@_add(sql.query(sql.TRADES, "SELECT trade_id, round(sum(pnl_net_usdt) OVER a, 6) AS equity, round(greatest(max(e) OVER a, 0) - e, 6) AS drawdown FROM (SELECT *, sum(pnl_net_usdt) OVER (ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS e FROM closed) "
                "WINDOW a AS (ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING)"))
def account_curve(spark, d):
    """Equity and drawdown of one account over all pairs: a single series, run in chunks of about a thousand trades."""
    t = _closed(spark, d).withColumn("account", F.lit(1))
    return metrics.drawdowns(t, ["account"], ["exit_ts", "trade_id"], rows=1_000).select("trade_id", F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


@_add(sql.query(sql.TRADES, "SELECT pair, coalesce(close_reason, 'unknown') AS reason, count(*) AS n FROM closed GROUP BY 1, 2"))
def close_reasons(spark, d):
    return metrics.close_reasons(_closed(spark, d), ["pair"]).select("pair", F.explode("close_reasons").alias("reason", "n"))


@_add(sql.query(sql.TRADES, """, b AS (SELECT * FROM met), half AS (SELECT * FROM closed WHERE trade_id % 2 = 0),
heq AS (SELECT *, sum(pnl_net_usdt) OVER (PARTITION BY pair ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING) AS equity FROM half),
hdd AS (SELECT *, greatest(max(equity) OVER (PARTITION BY pair ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING), 0) AS peak FROM heq),
c AS (SELECT pair, count(*) FILTER (WHERE pnl_net_usdt > 0) / count(*) AS win_rate, sum(pnl_net_usdt) AS total_pnl_usdt,
  coalesce(sum(pnl_net_usdt) FILTER (WHERE pnl_net_usdt > 0), 0) / nullif(abs(sum(pnl_net_usdt) FILTER (WHERE pnl_net_usdt <= 0)), 0) AS profit_factor,
  CASE WHEN count(*) >= 2 AND stddev_samp(pnl_pct) > 0 THEN avg(pnl_pct) / stddev_samp(pnl_pct) * sqrt(105120) ELSE 0 END AS sharpe_ratio,
  CASE WHEN max(peak) > 0 THEN max(peak - equity) / max(peak) * 100 ELSE 0 END AS max_drawdown_pct FROM hdd GROUP BY pair),""" + sql.compared("b", "c") + "\nSELECT pair, metric, result, verdict FROM judged"))
def compare_metrics(spark, d):
    t = _closed(spark, d)
    half = metrics.summary(t.filter("trade_id % 2 = 0"), ["pair"], ["exit_ts", "trade_id"])
    return metrics.compare(_summary(spark, d), half, ["pair"]).select("pair", "metric", "result", "verdict")


def _checks(which) -> str:
    rows = ", ".join(f"{{'m': '{m}', 'v': {m}::DOUBLE, 'ok': coalesce({m} {op} {limit}::DOUBLE, false)}}" for m, op, limit in which)
    return f"SELECT pair, unnest([{rows}]) AS c, CASE WHEN list_bool_and(list_transform([{rows}], lambda x: x.ok)) THEN 'GO' ELSE 'NO-GO' END AS verdict FROM met"


@_add(sql.query(sql.TRADES, f", a AS ({_checks(metrics.LONG_RUN)}), b AS ({_checks(metrics.SHORT_RUN)}), u AS (SELECT 'long' AS run, * FROM a UNION ALL SELECT 'short', * FROM b) "
                "SELECT run, pair, c.m AS metric, round(c.v, 6) AS value, CASE WHEN c.ok THEN 'PASS' ELSE 'FAIL' END AS result, verdict FROM u"))
def go_live(spark, d):
    """Both sets of checks before going live, per pair."""
    s = _summary(spark, d)
    both = [metrics.go_live(s, ["pair"], checks).withColumn("run", F.lit(run)) for run, checks in (("long", metrics.LONG_RUN), ("short", metrics.SHORT_RUN))]
    return both[0].unionByName(both[1]).withColumn("value", F.round("value", 6)).select("run", "pair", "metric", "value", "result", "verdict")


@_add(sql.query(sql.TRADES, f"SELECT trade_id, coalesce(exit_ts + 172800000 <= {MAR_1996}, false) AS context_post_complete FROM trades"))
def context_post_complete(spark, d):
    return store.mark_post_complete(_trades(spark, d), MAR_1996).select("trade_id", "context_post_complete")


@_add(sql.query(sql.TRADES, """, f AS (SELECT pattern, direction, session, regime, list(pnl_pct ORDER BY exit_ts, pnl_pct) AS p, count(*) FILTER (WHERE pnl_net_usdt > 0) AS w, max(exit_ts) AS u FROM closed GROUP BY ALL)
SELECT pattern, direction, session, regime, CAST(len(p) AS BIGINT) AS sample_count, w AS win_count, round(w::DOUBLE / len(p), 4) AS win_rate, u AS last_updated,
  list_reduce(list_transform(p, lambda x, i: {'n': i, 'a': printf('%.4f', x)::DOUBLE}), lambda s, x: {'n': x.n, 'a': printf('%.4f', (s.a * (x.n - 1) + p[x.n]) / x.n)::DOUBLE}).a AS avg_pnl_pct FROM f"""))
def memory_stepwise(spark, d):
    """Memory as it grows trade by trade, its mean rounded at every step and compared to the last of its four decimals."""
    return memory.stepwise(_closed(spark, d))


@_add(sql.query(sql.TRADES, f"{_DAYS} SELECT day_ts, printf('{messages.DAILY_SUMMARY.replace('%s', '%d active')}', trades, {sql.half_up('win_rate * 100', 1)}, {sql.half_up('pnl', 4)}, active) AS message FROM day"))
def daily_messages(spark, d):
    return store.daily_summary(_trades(spark, d)).select("day_ts", messages.day_summed().alias("message"))


_MESSAGE = "CASE WHEN close_reason = 'liquidated' THEN printf('{0}', pair, n4, b, bot_id) WHEN pnl_net_usdt > 0 THEN printf('{1}', pair, upper(direction), e, n4, p2, close_reason) ELSE printf('{2}', pair, upper(direction), e, n4, p2, close_reason, b) END"


@_add(sql.query(sql.TRADES, f", t AS (SELECT * REPLACE (CASE WHEN trade_id % 8 = 1 THEN 'liquidated' ELSE coalesce(close_reason, 'manual') END AS close_reason), CAST(round(entry_price, 2) AS VARCHAR) AS e, CAST(round(entry_price, 2) AS VARCHAR) AS b, {sql.half_up('pnl_net_usdt', 4)} AS n4, CASE WHEN pnl_pct < 0 THEN -abs({sql.half_up('pnl_pct', 2)}) ELSE {sql.half_up('pnl_pct', 2)} END AS p2 FROM closed)\n"
                f"SELECT trade_id, {_MESSAGE.format(messages.LIQUIDATION, messages.CLOSED_PROFIT, messages.CLOSED_LOSS)} AS message FROM t"))
def close_messages(spark, d):
    """What is said of each closed trade."""
    t = _closed(spark, d).withColumns({"close_reason": F.when(F.col("trade_id") % 8 == 1, "liquidated").otherwise(F.coalesce("close_reason", F.lit("manual"))),
                                       "exit_price": F.round("entry_price", 2), "bucket_balance_after": F.round("entry_price", 2)})
    return t.select("trade_id", messages.trade_closed().alias("message"))


@_add(sql.query(sql.GATES, """, l AS (SELECT pair, ts, coalesce(CASE WHEN regime <> 'QUIET' THEN regime END, 'None') AS regime FROM gate),
m AS (SELECT *, lag(regime) OVER (PARTITION BY pair ORDER BY ts) AS before FROM l)
SELECT ts, regime, '<b>REGIME CHANGE</b> → ' || regime || chr(10) || 'Pairs: ' || string_agg(pair, ', ' ORDER BY pair) AS message FROM m WHERE before <> regime GROUP BY ts, regime"""))
def regime_messages(spark, d):
    """Regime changes of all pairs at a time."""
    return store.regime_changes(signals.labelled(_windowed(spark, d))).select("ts", "regime", messages.regime_changed().alias("message"))


@_add("SELECT e.event_id, e.event_type, o.o_orderkey AS trade_id, o.o_orderpriority AS pair FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id")
def event_trades(spark, d):
    """Events with the trade they refer to."""
    e = _read(spark, d, "events").select("event_id", "event_type", F.col("event_id").alias("trade_id"))
    t = _trades(spark, d).withColumn("found", F.col("trade_id"))
    return store.with_trades(e, t, "pair", "found").select("event_id", "event_type", F.col("found").alias("trade_id"), "pair")


@_add(sql.query(sql.CANDLES, """, t AS (SELECT pair || ':' || ts AS trade_id, pair, ts AS entry_ts FROM candles WHERE volume >= 4),
n AS (SELECT trade_id, c.ts AS candle_ts, 'pre' AS "window", t.entry_ts FROM t JOIN candles c ON c.pair = t.pair AND c.ts BETWEEN entry_ts - 172800000 AND entry_ts - 1)
SELECT trade_id, candle_ts, CASE WHEN candle_ts % 7200000 = 0 THEN 'stored' ELSE "window" END AS "window" FROM n"""))
def context_links(spark, d):
    """Context rows added once: of those that are stored, the stored one stays."""
    c = _candles(spark, d)
    t = c.filter("volume >= 4").select(F.concat_ws(":", "pair", "ts").alias("trade_id"), "pair", F.col("ts").alias("entry_ts"), F.col("ts").alias("exit_ts"))
    rows = store.trade_context(t, c).filter("window = 'pre'").select("trade_id", "candle_ts", "window")
    stored = rows.filter(F.col("candle_ts") % 7_200_000 == 0).withColumn("window", F.lit("stored"))
    return store.link_context(stored, rows.unionByName(rows))


@_add(sql.query(sql.TRADES, f"SELECT round(coalesce(sum(pnl_net_usdt), 0), 6) AS session_pnl FROM trades WHERE bot_id = 'dev-bot' AND env = 'dev' AND exit_ts IS NOT NULL AND exit_ts >= {MAR_1996}"))
def session_pnl(spark, d):
    return store.session_pnl(_trades(spark, d), MAR_1996, "dev-bot", "dev").select(F.round("session_pnl", 6).alias("session_pnl"))


@_add(sql.query(sql.TRADES, "SELECT pair, trade_id, direction, pattern, entry_price, strftime(make_timestamp_ms(entry_ts), '%H:%M:%S') AS opened_at FROM trades WHERE exit_ts IS NULL"))
def open_positions(spark, d):
    clock = F.lpad(F.pmod(F.floor(F.col("entry_ts") / HOUR_MS), F.lit(24)).cast("string"), 2, "0")
    rest = F.floor(F.pmod("entry_ts", F.lit(HOUR_MS)) / 1000)
    at = F.concat_ws(":", clock, F.lpad(F.floor(rest / 60).cast("string"), 2, "0"), F.lpad((rest % 60).cast("string"), 2, "0"))
    return store.open_positions(_trades(spark, d)).select("pair", "trade_id", "direction", "pattern", "entry_price", at.alias("opened_at"))


@_add(sql.query(sql.TRADES, "SELECT bot_id, count(*) AS active FROM trades WHERE exit_ts IS NULL GROUP BY bot_id"))
def active_count(spark, d):
    return store.open_positions(_trades(spark, d)).groupBy("bot_id").agg(F.count(F.lit(1)).alias("active"))


@_add(sql.query(sql.TRADES, """SELECT count(*) AS total_trades, count(*) FILTER (WHERE exit_ts IS NOT NULL) AS closed, count(*) FILTER (WHERE exit_ts IS NULL) AS open,
count(*) FILTER (WHERE pnl_net_usdt > 0) AS wins, round(count(*) FILTER (WHERE pnl_net_usdt > 0)::DOUBLE / nullif(count(*) FILTER (WHERE exit_ts IS NOT NULL), 0) * 100, 1) AS win_rate_pct,
round(coalesce(sum(pnl_net_usdt) FILTER (WHERE exit_ts IS NOT NULL), 0), 4) AS total_pnl_usdt, round(coalesce(avg(pnl_pct) FILTER (WHERE pnl_net_usdt > 0), 0), 2) AS avg_win_pct,
round(coalesce(avg(pnl_pct) FILTER (WHERE pnl_net_usdt <= 0 AND exit_ts IS NOT NULL), 0), 2) AS avg_loss_pct FROM trades"""))
def session_stats(spark, d):
    return store.session_stats(_trades(spark, d))


@_add(sql.query(sql.TRADES, f"{_DAYS} SELECT day_ts, trades, wins, round(pnl, 6) AS pnl, round(win_rate, 8) AS win_rate, active FROM day"))
def daily_summary(spark, d):
    return store.daily_summary(_trades(spark, d)).select("day_ts", "trades", "wins", F.round("pnl", 6).alias("pnl"), *_r8("win_rate"), "active")


@_add(sql.query(sql.SIGNALS, "SELECT round(min(atr14 / close * 100), 8) AS min_atr_pct, round(avg(atr14 / close * 100), 8) AS mean_atr_pct, round(max(atr14 / close * 100), 8) AS max_atr_pct, "
                "count(*) FILTER (WHERE atr14 / close * 160 > 0.27) AS viable FROM sig WHERE close > 0"))
def atr_distribution(spark, d):
    pct = F.col("atr14") / F.col("close") * 100
    return _enriched(spark, d).filter("close > 0").agg(F.round(F.min(pct), 8).alias("min_atr_pct"), F.round(F.avg(pct), 8).alias("mean_atr_pct"), F.round(F.max(pct), 8).alias("max_atr_pct"),
                                                       F.count_if(F.col("atr14") / F.col("close") * 160 > 0.27).alias("viable"))


@_add(sql.query(sql.PATTERNS, """SELECT pattern, direction, count(*) AS n FROM (SELECT 'impulse_retracement' AS pattern, d_impulse AS direction FROM det UNION ALL SELECT 'wick_rejection', d_wick FROM det
UNION ALL SELECT 'compression_breakout', d_compression FROM det UNION ALL SELECT 'momentum_continuation', d_momentum FROM det UNION ALL SELECT 'anomaly_fade', d_anomaly FROM det)
WHERE direction IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, pattern, direction LIMIT 10"""))
def top_patterns(spark, d):
    df = detect(_windowed(spark, d))
    hits = F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"p_{n}")["direction"].alias("direction")) for _, n, _ in sql.DETECTORS])
    return store.top(df.select(F.explode(hits).alias("h")).select("h.*").filter("direction is not null"), ["pattern", "direction"])


@_add(sql.query(sql.CANDLES, f"""SELECT pair, ts, CASE WHEN ts >= {JAN_10} THEN close + 1 ELSE close END AS close, volume, CASE WHEN ts < {JAN_10} THEN 'dev' ELSE 'seed' END AS env
FROM candles WHERE ts < {JAN_10} UNION ALL SELECT pair, ts, close + 1, volume, 'seed' FROM candles WHERE ts >= {JAN_10}"""))
def candle_upsert(spark, d):
    """Stored candles of one env, rewritten from a date on, with new ones before it."""
    c = _candles(spark, d)
    stored = since(c, JAN_10).withColumn("env", F.lit("seed"))
    incoming = c.withColumn("close", F.when(F.col("ts") >= JAN_10, F.col("close") + 1).otherwise(F.col("close")))
    return store.upsert_candles(stored, incoming).select("pair", "ts", "close", "volume", "env")


#: What the merged candle store holds.
_STORED = "bot_id string, pair string, timeframe string, ts bigint, open double, high double, low double, close double, volume double, env string"


@_add(SQL["candle_upsert"])
def candle_store_stream(spark, d):
    """The same through the merge-on-read store: a first version, streamed later ones, compacted on the way, one batch twice."""
    c, root = materialise(_candles(spark, d), "store-candles"), scratch_uri(spark, "store")
    held = versions.VersionStore(f"{root}/table", _STORED)
    held.write(since(c, JAN_10).withColumn("env", F.lit("seed")), 0)
    incoming = c.withColumn("close", F.when(F.col("ts") >= JAN_10, F.col("close") + 1).otherwise(F.col("close")))
    incoming.repartition(3, "pair").write.parquet(f"{root}/in")

    def sink(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2 if batch_id == 0 else 1):
            held.write(batch, batch_id + 1)
        if batch_id == 1:
            held.compact(spark)

    feed = spark.readStream.schema(incoming.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    feed.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return held.read(spark).select("pair", "ts", "close", "volume", "env")


@_add(sql.query(sql.CANDLES, f"SELECT pair, ts, close FROM candles WHERE ts >= {JAN_10} + 5 * 3600000 OR volume >= 3"))
def retention_by_days(spark, d):
    """Candles in day partitions after retention: old days go as folders, those with referenced candles are rewritten."""
    c, root = _candles(spark, d).withColumn("candle_id", F.concat_ws(":", "pair", "ts")), scratch_uri(spark, "days")
    c.withColumn("day", F.floor(F.col("ts") / DAY_MS)).repartition("day").write.partitionBy("day").parquet(root)
    versions.expire_days(spark, root, JAN_10 + 5 * HOUR_MS + 90 * DAY_MS, 90, c.filter("volume >= 3"))
    return spark.read.parquet(root).select("pair", "ts", "close")


@_add(sql.query(sql.CANDLES, f"SELECT pair, ts FROM candles c WHERE ts < {JAN_10} AND NOT EXISTS (SELECT 1 FROM candles x WHERE x.volume >= 3 AND x.pair = c.pair AND x.ts = c.ts)"))
def retention_anti_join(spark, d):
    c = _candles(spark, d).withColumn("candle_id", F.concat_ws(":", "pair", "ts"))
    return store.expired_candles(c, c.filter("volume >= 3"), JAN_10 + 90 * DAY_MS).select("pair", "ts")


@_add(sql.query(sql.CANDLES, """, t AS (SELECT row_number() OVER (ORDER BY pair, ts) AS trade_id, pair, ts AS entry_ts, ts + 7200000 AS exit_ts FROM candles WHERE volume >= 4),
t2 AS (SELECT pair || ':' || entry_ts AS trade_id, pair, entry_ts, exit_ts FROM t),
num AS (SELECT pair, ts, row_number() OVER (PARTITION BY pair ORDER BY ts) AS k FROM candles),
t3 AS (SELECT *, (SELECT count(*) FROM candles x WHERE x.pair = t2.pair AND x.ts < t2.entry_ts) + 1 AS entry_k, (SELECT count(*) FROM candles x WHERE x.pair = t2.pair AND x.ts < t2.exit_ts) + 1 AS exit_k FROM t2)
SELECT trade_id, 'pre' AS "window", c.ts AS candle_ts, round((c.ts - entry_ts) / 3600000, 8) AS offset_hours, CAST(c.k - entry_k AS INTEGER) AS offset_candles FROM t3 JOIN num c ON c.pair = t3.pair AND c.ts BETWEEN entry_ts - 172800000 AND entry_ts - 1
UNION ALL SELECT trade_id, 'post', c.ts, round((c.ts - exit_ts) / 3600000, 8), CAST(c.k - exit_k AS INTEGER) FROM t3 JOIN num c ON c.pair = t3.pair AND c.ts BETWEEN exit_ts AND exit_ts + 172800000"""))
def trade_context_range(spark, d):
    c = _candles(spark, d)
    t = c.filter("volume >= 4").select(F.concat_ws(":", "pair", "ts").alias("trade_id"), "pair", F.col("ts").alias("entry_ts"), (F.col("ts") + 2 * HOUR_MS).alias("exit_ts"))
    return store.trade_context(t, c).select("trade_id", "window", "candle_ts", *_r8("offset_hours"), "offset_candles")


@_add(sql.query(sql.TRADES, "SELECT pattern, direction, session, regime, count(*) AS sample_count, count(*) FILTER (WHERE pnl_net_usdt > 0) AS win_count, round(count(*) FILTER (WHERE pnl_net_usdt > 0)::DOUBLE / count(*), 4) AS win_rate, "
                "max(exit_ts) AS last_updated FROM closed GROUP BY 1, 2, 3, 4"))
def memory_stats(spark, d):
    return memory.stats(_closed(spark, d)).drop("avg_pnl_pct")


@_add(sql.query(sql.TRADES, """, mem AS (SELECT pattern, direction, session, regime, count(*) AS n, round(count(*) FILTER (WHERE pnl_net_usdt > 0)::DOUBLE / count(*), 4) AS wr FROM closed GROUP BY 1, 2, 3, 4)
SELECT t.trade_id, round(CASE WHEN n >= 10 THEN round(greatest(0.3::DOUBLE, least(0.95::DOUBLE, 0.6::DOUBLE * 0.7::DOUBLE + wr * 0.3::DOUBLE)), 3) ELSE 0.6::DOUBLE END, 8) AS confidence, coalesce(n >= 20 AND wr < 0.35, false) AS suppressed
FROM tsess t LEFT JOIN mem USING (pattern, direction, session, regime)"""))
def memory_adjust(spark, d):
    met = memory.lookup(_trades(spark, d), memory.stats(_closed(spark, d)))
    return met.select("trade_id", F.round(memory.adjust(F.lit(0.6), F.col("sample_count"), F.col("win_rate")), 8).alias("confidence"), memory.suppressed(F.col("sample_count"), F.col("win_rate")).alias("suppressed"))


@_add("WITH b AS (SELECT 'bot-' || (user_id % 10) AS bot_id, epoch_us(ts) // 1000 AS ts, CAST(event_id AS INTEGER) AS pid, event_type AS status FROM events), "
      "l AS (SELECT bot_id, max(ts) AS ts, arg_max(pid, ts) AS pid, arg_max(status, ts) AS status FROM b GROUP BY 1) "
      "SELECT *, ((SELECT max(ts) FROM b) - ts) / 1000 > 90 AS stale FROM l")
def latest_heartbeat(spark, d):
    beats = heartbeats_from_events(_read(spark, d, "events"))
    now = beats.agg(F.max("ts").alias("m")).first()["m"] or 0
    return store.stale(beats, now).select("bot_id", "ts", "pid", "status", "stale")


@_add(sql.query(sql.CANDLES, "SELECT pair, ts, close FROM candles QUALIFY row_number() OVER (PARTITION BY pair ORDER BY ts DESC) <= 120"))
def recent_n_candles(spark, d):
    return recent(_candles(spark, d), 120).select("pair", "ts", "close")


@_add(sql.query(sql.CANDLES, """SELECT pair, ts, CASE WHEN row_number() OVER (PARTITION BY pair ORDER BY ts) <= floor(0.6::DOUBLE * count(*) OVER (PARTITION BY pair)) THEN 'in_sample' ELSE 'out_sample' END AS fold FROM candles"""))
def walk_forward_split(spark, d):
    return backtest.fold_split(_candles(spark, d)).select("pair", "ts", "fold")


@_add(sql.query(sql.POSITIONS, "SELECT pair, ts, close_reason, hold_candles, round(gross, 6) AS pnl_gross_usdt FROM position"))
def position_results(spark, d):
    """Every candle taken as an entry, long on even hours and short on odd ones."""
    return _positions(spark, d).select("pair", "ts", "close_reason", "hold_candles", "pnl_gross_usdt")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    even = F.floor(F.col("ts") / HOUR_MS) % 2 == 0
    sign = F.when(even, 1.0).otherwise(-1.0)
    df = moves(_enriched(spark, d)).withColumns({"outcome": F.lit("fired"), "side": F.when(even, "long").otherwise("short"), "entry_price": F.col("close"), "size_usdt": F.lit(10.0),
                                                 "tp_price": F.round(F.col("close") + sign * F.col("atr14") * 1.6, 8), "sl_price": F.round(F.col("close") - sign * F.col("atr14"), 8)})
    df = backtest.exits(backtest.entries(df, 20)).withColumn("fill", F.when(F.col("fill") > 0, F.col("fill")))
    return backtest.closes(df)


#: The detector that a candle's position counts for, by its hour, so that memory grows on all of them.
_NAMES = ("impulse_retracement", "wick_rejection", "compression_breakout", "momentum_continuation", "anomaly_fade")


@_add(sql.query(sql.remembered(LOOSE, sql.POSITIONS + f""",
past AS (SELECT ({list(_NAMES)})[1 + (ts // 3600000) % 5] AS pattern, CASE WHEN k = 1 THEN 'long' ELSE 'short' END AS direction, exit_ts, round(gross, 6) AS pnl FROM position)"""),
    "SELECT pair, ts, outcome, stage, reason, pattern, side, confidence, best.pattern AS best_pattern, best.confidence AS best_confidence FROM sig"))
def memory_signals(spark, d):
    """Signals under the memory that each candle could have: of positions closed before it."""
    past = _positions(spark, d).select(F.element_at(F.array(*map(F.lit, _NAMES)), (F.lit(1) + F.floor(F.col("ts") / HOUR_MS) % 5).cast("int")).alias("pattern"), F.col("side").alias("direction"), "exit_ts",
                                       F.col("pnl_gross_usdt").alias("pnl_net_usdt"))
    df = signals.evaluate_at_time(_windowed(spark, d), past, LOOSE, keep_best=True)
    return df.select("pair", "ts", "outcome", "stage", "reason", "pattern", "side", "confidence", F.col("best.pattern").alias("best_pattern"), F.col("best.confidence").alias("best_confidence"))


@_add(sql.query(sql.TRADES, "SELECT trade_id, CASE WHEN trade_id % 2 = 0 THEN exit_ts END AS exit_ts, CASE WHEN trade_id % 2 = 0 THEN close_reason END AS close_reason FROM trades"))
def trade_closes(spark, d):
    """Opened trades updated by the closing rows of every other one."""
    t = _trades(spark, d)
    opened = t.withColumns({"exit_ts": F.lit(None).cast("long"), "close_reason": F.lit(None).cast("string")})
    return store.close_trades(opened, t.filter("exit_ts is not null and trade_id % 2 = 0").select("trade_id", "exit_ts", "close_reason")).select("trade_id", "exit_ts", "close_reason")


@_add(f"SELECT event_id, epoch_us(ts) // 1000 AS ts FROM events WHERE epoch_us(ts) // 1000 >= {JAN_10}")
def event_retention(spark, d):
    return store.retained(log_from_events(_read(spark, d, "events")), JAN_10 + 30 * DAY_MS, 30).select("event_id", "ts")


@_add("SELECT event_id, CAST(to_json({'event_id': event_id, 'category': event_type}) AS VARCHAR) AS line FROM events")
def event_export(spark, d):
    return log_from_events(_read(spark, d, "events")).select("event_id", F.to_json(F.struct("event_id", "category")).alias("line"))


@_add("SELECT event_type AS pair, count(DISTINCT epoch_us(ts) // 3600000000) AS candles FROM events GROUP BY 1")
def candle_dedupe(spark, d):
    """Candles delivered twice count once."""
    c = _candles(spark, d)
    return dedupe(c.unionByName(c)).groupBy("pair").agg(F.count(F.lit(1)).alias("candles"))


@_add(f"SELECT event_id, epoch_us(ts) // 1000 AS ts, event_type AS category, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE epoch_us(ts) // 1000 >= {JAN_10} AND event_type IN ('error', 'purchase') ORDER BY ts LIMIT 100")
def event_log_filter(spark, d):
    log = event_log(log_from_events(_read(spark, d, "events")), JAN_10, categories=("error", "purchase"))
    return log.select("event_id", "ts", "category", F.get_json_object("payload", "$.k").cast("long").alias("k"))


@_add("SELECT event_id, epoch_us(ts) // 1000 AS ts, event_type AS category FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def last_events(spark, d):
    """The newest twenty log rows."""
    return log_from_events(_read(spark, d, "events")).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "category")


@_add(sql.query(sql.CANDLES, "SELECT pair, ts, open, high, low, close, volume FROM candles WHERE pair = 'click' AND ts < (SELECT max(ts) FROM candles WHERE pair = 'click')"))
def paged_history(spark, d):
    """One pair's history from pages of two exchanges: the first lacks every seventh candle and a fifth of its pages."""
    ship(spark)
    spark.dataSource.register(CandlePages)
    c, root = materialise(_candles(spark, d).filter("pair = 'click'"), "paged-candles"), scratch_uri(spark, "pages")
    hour = F.floor(F.col("ts") / HOUR_MS)
    write_pages(c.filter((hour % 7 != 0) & (F.floor(hour / 100) % 5 != 0)), f"{root}/first", 100)
    write_pages(c, f"{root}/second", 60)
    last = c.agg(F.max("ts")).first()[0] or 0
    reader = spark.read.format("candle_pages").options(roots=f"{root}/none,{root}/first,{root}/second", timeframe="1h", pair="click", now=str(last + HOUR_MS), pagespertask="2")
    return reader.load().select("pair", "ts", "open", "high", "low", "close", "volume")


@_add(sql.query(sql.CANDLES, "SELECT pair, ts, open, high, low, close, volume FROM candles"))
def ohlcv_json_round_trip(spark, d):
    """Candles written as OHLCV JSON, a folder per pair, and read back."""
    c, root, out = materialise(_candles(spark, d), "json-candles"), scratch_uri(spark, "json"), None
    for pair in sorted(r[0] for r in c.select("pair").distinct().collect()):  # event types: a handful
        write_ohlcv_json(c.filter(F.col("pair") == pair), f"{root}/{pair}", 2)
        rows = read_ohlcv_json(spark, f"{root}/{pair}", pair, "1h")
        out = rows if out is None else out.unionByName(rows)
    return out.select("pair", "ts", "open", "high", "low", "close", "volume")


@_add(sql.query(sql.CANDLES, "SELECT pair, ts, open, high, low, close, volume FROM candles WHERE ts + 3600000 <= (SELECT max(ms) - 600000 FROM ticks)"))
def stream_candles(spark, d):
    """Closed windows of the streamed events; the tail within the watermark stays open."""
    root = scratch_uri(spark, "stream")
    q = stream.to_files(stream.closed_candles(stream.stream_events(spark, f"{d}/events.parque[t]")), f"{root}/candles", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/candles").select("pair", "ts", "open", "high", "low", "close", "volume")


def _streamed(spark: SparkSession, d: str) -> str:
    """The folder of the tick-to-trade stream over all events."""
    root = scratch_uri(spark, "trading")
    ticks = stream.stream_events(spark, f"{d}/events.parque[t]")
    trading.start(trading.trading(stream.closed_candles(ticks), LOOSE), f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return f"{root}/rows"


@_add(sql.query(sql.closed_only(sql.simulation(LOOSE)), """SELECT pair, ts, CASE WHEN outcome = 'fired' AND (risk_reason IS NOT NULL OR NOT coalesce(taken, false)) THEN 'rejected' ELSE outcome END AS outcome,
CASE WHEN outcome = 'fired' THEN CASE WHEN risk_reason IS NOT NULL OR NOT coalesce(taken, false) THEN 'risk' END ELSE stage END AS stage,
CASE WHEN outcome = 'fired' THEN coalesce(risk_reason, CASE WHEN NOT coalesce(taken, false) THEN 'daily_loss_limit' END) ELSE reason END AS reason,
CASE WHEN risk_reason IS NULL AND taken THEN pattern END AS pattern, CASE WHEN risk_reason IS NULL AND taken THEN side END AS direction, CASE WHEN risk_reason IS NULL AND taken THEN confidence END AS confidence
FROM fate WHERE NOT held"""))
def stream_signal_log(spark, d):
    """What the stream from ticks to trades logs for every candle on which no position is open."""
    return trading.signal_log(spark, _streamed(spark, d)).drop("bot_id", "timeframe")


@_add(sql.query(sql.closed_only(sql.simulation(LOOSE)), """SELECT pair, side AS direction, pattern, ts AS entry_ts, exit_ts, close_reason, CAST(greatest((exit_ts - ts) // 900000, 1) AS INTEGER) AS hold_candles,
round(fill, 6) AS entry_price, round(price, 6) AS exit_price, round(net, 5) AS pnl_net_usdt, round(net / size_usdt * 100, 4) AS pnl_pct FROM fate WHERE taken AND NOT forced"""))
def stream_trades(spark, d):
    """Trades that the stream closes; a position still open at its end has no row."""
    t = trading.trades(spark, _streamed(spark, d))
    return t.select("pair", "direction", "pattern", "entry_ts", "exit_ts", "close_reason", "hold_candles", *[F.round(c, 6).alias(c) for c in ("entry_price", "exit_price")],
                    F.round("pnl_net_usdt", 5).alias("pnl_net_usdt"), F.round("pnl_pct", 4).alias("pnl_pct"))
