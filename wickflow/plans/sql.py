"""DuckDB twins of the batch queries, built from shared common table expressions.

Recursive averages are written here as weighted sums over the frame, not as
folds, so they check the folds instead of repeating them.
"""

from __future__ import annotations

from wickflow.operators.metrics import COMPARED
from wickflow.params import Params

P = Params()
FRAME = 120


def ema(values: str, p: int) -> str:
    k = 2.0 / (p + 1)
    return (f"CASE WHEN len({values}) <= {p} THEN list_avg({values}) ELSE list_sum(list_transform({values}, lambda x, i: x * CASE WHEN i <= {p} "
            f"THEN pow({1 - k!r}, len({values}) - {p}) / {p} ELSE {k!r} * pow({1 - k!r}, len({values}) - i) END)) END")


def wilder(values: str, p: int) -> str:
    a = f"({p - 1}::DOUBLE / {p})"
    return (f"CASE WHEN len({values}) = 0 THEN 0.0 WHEN len({values}) < {p} THEN list_avg({values}) ELSE list_sum(list_transform({values}, lambda x, i: x * CASE WHEN i <= {p} "
            f"THEN pow({a}, len({values}) - {p}) / {p} ELSE pow({a}, len({values}) - i) / {p} END)) END")


def _smooth(values: str, t: str = "t") -> str:
    return f"list_sum(list_transform({values}[1:{t}], lambda x, i: x * CASE WHEN i <= 14 THEN pow(13::DOUBLE / 14, {t} - 14) ELSE pow(13::DOUBLE / 14, {t} - i) END))"


CANDLES = """
ticks AS (SELECT event_type AS pair, epoch_us(ts) // 1000 AS ms, event_id, value FROM events),
candles AS (SELECT pair, ms - ms % 3600000 AS ts, first(value ORDER BY ms, event_id) AS open, max(value) AS high, min(value) AS low,
                   last(value ORDER BY ms, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY pair, ms - ms % 3600000)"""

_ALL_WINDOWS = "GROUP BY pair, ms - ms % 3600000)"


def closed_only(ctes: str, step: int = 3_600_000, delay: int = 600_000) -> str:
    """The same over windows that a watermark ``delay`` behind the newest tick has passed."""
    assert ctes.count(_ALL_WINDOWS) == 1
    return ctes.replace(_ALL_WINDOWS, f"{_ALL_WINDOWS[:-1]} HAVING ms - ms % {step} + {step} <= (SELECT max(ms) - {delay} FROM ticks))")


GEOMETRY = CANDLES + """,
geo AS (SELECT *, abs(close - open) AS body_size, high - low AS total_range, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick,
               CASE WHEN close >= open THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN high - low > 0 THEN abs(close - open) / (high - low) ELSE 0.0 END AS body_ratio,
               CASE WHEN (ts // 3600000) % 24 BETWEEN 13 AND 15 THEN 'overlap' WHEN (ts // 3600000) % 24 BETWEEN 8 AND 12 THEN 'london'
                    WHEN (ts // 3600000) % 24 BETWEEN 16 AND 20 THEN 'us' ELSE 'asian' END AS session FROM candles)"""

_W = "PARTITION BY pair ORDER BY ts"
MOVES = GEOMETRY + f""",
prior AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM geo WINDOW w AS ({_W})),
mv AS (SELECT *, CASE WHEN pc IS NULL THEN 0.0 ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
              CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS up,
              CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS down, coalesce(close - pc, 0.0) AS delta FROM prior)"""

FRAMES = MOVES + f""",
fr AS (SELECT *, list(close) OVER f AS cl, (list(tr) OVER f)[2:] AS tl, (list(up) OVER f)[2:] AS ul, (list(down) OVER f)[2:] AS dl, (list(delta) OVER f)[2:] AS el,
              (list(tr) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 119 PRECEDING AND 1 PRECEDING))[2:] AS pl_tr,
              avg(close) OVER g AS sma20, stddev_pop(close) OVER g AS sd20, count(*) OVER g AS n20, avg(volume) OVER g AS volume_ma20, stddev_pop(volume) OVER g AS vsd,
              avg(tr) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS tr5, avg(tr) OVER g AS tr20
       FROM mv WINDOW f AS ({_W} ROWS BETWEEN {FRAME - 1} PRECEDING AND CURRENT ROW), g AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""

INDICATORS = FRAMES + f""",
wild AS (SELECT *, {ema('cl', P.ema_fast)} AS ema9, {ema('cl', P.ema_slow)} AS ema21, {wilder('tl', 14)} AS atr14,
                {wilder('list_transform(el, lambda q: greatest(q, 0.0))', 14)} AS ag, {wilder('list_transform(el, lambda q: greatest(-q, 0.0))', 14)} AS al,
                list_transform(range(14, len(tl) + 1), lambda t: {{'t': {_smooth('tl')}, 'u': {_smooth('ul')}, 'd': {_smooth('dl')}}}) AS sm,
                CASE WHEN rn >= 51 THEN {wilder('tl', 50)} END AS atr50_w, {wilder('coalesce(pl_tr, [])', 14)} AS atr14_prev,
                CASE WHEN n20 >= 20 THEN 2 * sd20 ELSE 0 END AS band, CASE WHEN volume_ma20 > 0 THEN volume / volume_ma20 ELSE 1.0 END AS volume_ratio,
                CASE WHEN n20 < 2 THEN 0.0 ELSE vsd END AS volume_sd20 FROM fr),
dxs AS (SELECT *, list_transform(sm, lambda z: CASE WHEN z.t = 0 OR z.u + z.d = 0 THEN 0.0 ELSE 100 * abs(100 * z.u / z.t - 100 * z.d / z.t) / (100 * z.u / z.t + 100 * z.d / z.t) END) AS dx FROM wild),
ind AS (SELECT *, CASE WHEN len(el) < 14 THEN 50.0 WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi14,
               CASE WHEN len(tl) < 14 THEN 0.0 ELSE {wilder('dx', 14)} END AS adx, sma20 + band AS bb_upper, sma20 - band AS bb_lower,
               CASE WHEN n20 >= 20 AND sma20 <> 0 THEN 2 * band / sma20 ELSE 0.0 END AS bb_width, least(rn, {FRAME}) AS n FROM dxs)"""

#: Either side of the walk-forward split as a series of its own; stored indicators stay, frames start anew.
FOLDS = INDICATORS + f""",
side AS (SELECT pair || '|' || CASE WHEN row_number() OVER ({_W}) <= floor(0.6::DOUBLE * count(*) OVER (PARTITION BY pair)) THEN 'in_sample' ELSE 'out_sample' END AS pair, ts, open, high, low, close, volume,
                body_size, total_range, body_ratio, upper_wick, lower_wick, direction, session, ema9, ema21, rsi14, atr14, adx, bb_upper, bb_lower, bb_width, volume_ma20, volume_ratio FROM ind),
side_mv AS (SELECT *, row_number() OVER w AS rn, CASE WHEN lag(close) OVER w IS NULL THEN 0.0 ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM side WINDOW w AS ({_W})),
side_fr AS (SELECT *, (list(tr) OVER ({_W} ROWS BETWEEN {FRAME - 1} PRECEDING AND CURRENT ROW))[2:] AS tl, (list(tr) OVER ({_W} ROWS BETWEEN {FRAME - 1} PRECEDING AND 1 PRECEDING))[2:] AS pl_tr,
                   avg(tr) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS tr5, avg(tr) OVER ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tr20 FROM side_mv),
folds AS (SELECT *, CASE WHEN rn >= 51 THEN {wilder('tl', 50)} END AS atr50_w, {wilder('coalesce(pl_tr, [])', 14)} AS atr14_prev, least(rn, {FRAME}) AS n FROM side_fr)"""


def gates(p: Params, folds: bool = False) -> str:
    """Regime, trend and volume gates of each candle."""
    return (FOLDS if folds else INDICATORS) + f""",
reg AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN atr14 < coalesce(atr50_w, atr14) * {p.atr_quiet_multiplier} OR volume_ratio < 0.7 THEN 'QUIET'
                       WHEN atr14 > coalesce(atr50_w, atr14) * {p.atr_volatile_multiplier} AND adx > 15 THEN 'VOLATILE'
                       WHEN adx > {p.adx_trend_min} AND (CASE WHEN ema21 <> 0 THEN abs(ema9 - ema21) / ema21 ELSE 0 END) > {p.ema_spread_threshold} THEN 'TRENDING' ELSE 'RANGING' END AS regime,
               CASE WHEN ema9 > ema21 THEN 1 WHEN ema9 < ema21 THEN -1 ELSE 0 END AS k,
               CASE WHEN ema9 > ema21 AND rsi14 BETWEEN {p.rsi_low} AND {p.rsi_long_max} THEN 'long' WHEN ema9 < ema21 AND rsi14 BETWEEN {p.rsi_short_min} AND {p.rsi_high} THEN 'short' END AS trend FROM {'folds' if folds else 'ind'}),
str AS (SELECT *, min(k) OVER s AS lo, max(k) OVER s AS hi, count(k) OVER s AS pairs FROM reg WINDOW s AS ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
gat AS (SELECT *, n < 4 OR pairs < 2 OR coalesce(CASE WHEN trend = 'long' THEN lo = 1 WHEN trend = 'short' THEN hi = -1 END, false) AS streak_ok,
               CASE session WHEN 'asian' THEN 1.2 WHEN 'london' THEN 1.0 ELSE 0.9 END::DOUBLE * {p.volume_ratio_min}::DOUBLE AS volume_threshold FROM str),
gate AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient_candles' WHEN regime = 'QUIET' THEN 'quiet_regime' END AS regime_reject,
                CASE WHEN n < {p.ema_slow + 1} THEN 'insufficient_candles' WHEN trend IS NULL THEN 'no_trend_alignment' WHEN NOT streak_ok THEN 'no_trend_streak' END AS trend_reject,
                CASE WHEN volume_ratio < volume_threshold THEN 'volume_ratio_below_threshold' END AS volume_reject FROM gat)"""


_lag = ", ".join(f"lag({c}, {k}) OVER w AS {c}_{k}" for c in ("open", "close", "volume", "body_size", "body_ratio", "volume_ratio", "bb_width", "direction") for k in range(1, 5))
_bb = " AND ".join(f"bb_width_{k + 1} >= bb_width{'_' + str(k) if k else ''}" for k in range(4))


def patterns(p: Params, folds: bool = False) -> str:
    """Direction and confidence of each detector."""
    return gates(p, folds) + f""",
lg AS (SELECT *, {_lag}, min(low) OVER t AS low10, max(high) OVER t AS high10, avg(volume) OVER q AS vma_prev, stddev_pop(volume) OVER q AS vsd_prev
       FROM gate WINDOW w AS ({_W}), t AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), q AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
pre AS (SELECT *, CASE WHEN body_size_1 > 0 THEN body_size / body_size_1 ELSE 0 END AS share, CASE WHEN total_range > 0 THEN (close - low) / total_range ELSE 0 END AS place,
               CASE WHEN body_size > 0 THEN lower_wick / body_size ELSE 0 END AS lw, CASE WHEN body_size > 0 THEN upper_wick / body_size ELSE 0 END AS uw,
               CASE WHEN body_size_2 > 0 THEN body_size_1 / body_size_2 ELSE 1 END AS growth, CASE WHEN vma_prev > 0 THEN volume_1 / vma_prev ELSE 1 END AS times,
               CASE WHEN direction_1 = 'bullish' THEN 'long' ELSE 'short' END AS side_1 FROM lg),
pat AS (SELECT *,
  n >= 3 AND body_ratio_1 >= {p.body_ratio_min} AND volume_ratio_1 >= {p.volume_ratio_min} AND body_size_1 > 0 AND share BETWEEN {p.retracement_min} AND {p.retracement_max}
    AND volume < volume_1 AND direction <> direction_1 AND CASE WHEN direction_1 = 'bullish' THEN close >= open_1 ELSE close <= open_1 END AS f_impulse,
  n >= 3 AND atr14 <> 0 AND body_size <> 0 AND total_range <> 0 AND lw >= {p.wick_ratio_min} AND place >= 0.7 AND abs(low - low10) <= atr14 AS f_wick_long,
  n >= 3 AND atr14 <> 0 AND body_size <> 0 AND total_range <> 0 AND uw >= {p.wick_ratio_min} AND place <= 0.3 AND abs(high - high10) <= atr14 AS f_wick_short,
  n >= 25 AND tr20 <> 0 AND tr5 < tr20 * {p.compression_factor} AND {_bb} AND volume_3 >= volume_2 AND volume_2 >= volume_1 AND volume_ratio >= 1.5
    AND (close > bb_upper OR close < bb_lower) AS f_compression,
  n >= 4 AND direction_2 = direction_1 AND body_size_2 <= body_size_1 AND volume_2 <= volume_1 AND body_size_1 <> 0 AND body_size < 0.4::DOUBLE * body_size_1 AND volume < volume_1
    AND direction <> direction_1 AS f_momentum,
  n >= 22 AND atr14_prev <> 0 AND volume_1 >= vma_prev + {p.anomaly_volume_stddev} * vsd_prev AND abs(close_1 - open_1) >= {p.anomaly_price_atr} * atr14_prev
    AND CASE WHEN direction_1 = 'bullish' THEN close < close_1 ELSE close > close_1 END AS f_anomaly FROM pre),
det AS (SELECT *,
  CASE WHEN f_impulse THEN side_1 END AS d_impulse,
  CASE WHEN f_impulse THEN round(least(0.4::DOUBLE + body_ratio_1 * 0.3::DOUBLE + least(volume_ratio_1 / {p.volume_ratio_min}::DOUBLE - 1, 0.3::DOUBLE), 1), 3) END AS c_impulse,
  CASE WHEN f_wick_long THEN 'long' WHEN f_wick_short THEN 'short' END AS d_wick,
  CASE WHEN f_wick_long THEN round(least(0.45::DOUBLE + (lw - {p.wick_ratio_min}) * 0.1::DOUBLE + place * 0.15::DOUBLE, 1), 3)
       WHEN f_wick_short THEN round(least(0.45::DOUBLE + (uw - {p.wick_ratio_min}) * 0.1::DOUBLE + (1 - place) * 0.15::DOUBLE, 1), 3) END AS c_wick,
  CASE WHEN f_compression THEN CASE WHEN close > bb_upper THEN 'long' ELSE 'short' END END AS d_compression,
  CASE WHEN f_compression THEN round(least(0.5::DOUBLE + (volume_ratio - 1.5::DOUBLE) * 0.1::DOUBLE, 0.95::DOUBLE), 3) END AS c_compression,
  CASE WHEN f_momentum THEN side_1 END AS d_momentum,
  CASE WHEN f_momentum THEN round(least(0.5::DOUBLE + growth * 0.05::DOUBLE + 2 * 0.03::DOUBLE, 0.95::DOUBLE), 3) END AS c_momentum,
  CASE WHEN f_anomaly THEN CASE WHEN side_1 = 'long' THEN 'short' ELSE 'long' END END AS d_anomaly,
  CASE WHEN f_anomaly THEN round(least(0.5::DOUBLE + (times - 1) * 0.05::DOUBLE, 0.95::DOUBLE), 3) END AS c_anomaly FROM pat)"""


#: (short name, pattern, regimes) in registration order.
DETECTORS = (("impulse", "impulse_retracement", "('TRENDING')"), ("wick", "wick_rejection", "('RANGING')"), ("compression", "compression_breakout", "('VOLATILE')"),
             ("momentum", "momentum_continuation", "('TRENDING')"), ("anomaly", "anomaly_fade", "('VOLATILE', 'RANGING')"))
_cands = ", ".join(
    f"CASE WHEN d_{s} = trend AND regime IN {r} AND (session <> 'overlap' OR '{name}' = 'compression_breakout') THEN "
    f"{{'confidence': round(c_{s} / (CASE WHEN session = 'asian' THEN 1.1 ELSE 1.0 END)::DOUBLE, 3), 'ord': {-k}, 'pattern': '{name}', 'direction': d_{s}}} END" for k, (s, name, r) in enumerate(DETECTORS))


def signals(p: Params, folds: bool = False) -> str:
    """The fired signal or first rejection of each candle."""
    return patterns(p, folds) + f""",
scn AS (SELECT *, list_max(list_filter([{_cands}], lambda z: z IS NOT NULL)) AS best FROM det),
rej AS (SELECT *, CASE WHEN regime_reject IS NOT NULL THEN 'regime:' || regime_reject WHEN trend_reject IS NOT NULL THEN 'trend:' || trend_reject
                       WHEN best IS NULL THEN 'pattern:no_pattern_fired' WHEN best.confidence < {p.min_confidence}::DOUBLE * (CASE WHEN session = 'asian' THEN 1.1 ELSE 1.0 END)::DOUBLE THEN 'pattern:confidence_below_min'
                       WHEN volume_reject IS NOT NULL THEN 'volume:' || volume_reject WHEN coalesce(atr14, 0) = 0 THEN 'pattern:atr_unavailable' END AS rej FROM scn),
sig AS (SELECT *, CASE WHEN rej IS NULL THEN 'fired' ELSE 'rejected' END AS outcome, split_part(rej, ':', 1) AS stage, split_part(rej, ':', 2) AS reason,
               CASE WHEN rej IS NULL THEN best.pattern END AS pattern, CASE WHEN rej IS NULL THEN best.direction END AS side, CASE WHEN rej IS NULL THEN best.confidence END AS confidence,
               CASE WHEN rej IS NULL THEN round(close + (CASE WHEN best.direction = 'long' THEN 1 ELSE -1 END) * atr14 * {p.tp_atr_multiplier}::DOUBLE, 8) END AS tp_price,
               CASE WHEN rej IS NULL THEN round(close - (CASE WHEN best.direction = 'long' THEN 1 ELSE -1 END) * atr14 * {p.sl_atr_multiplier}::DOUBLE, 8) END AS sl_price,
               CASE WHEN rej IS NULL THEN CASE WHEN best.confidence >= 0.75 THEN 10.0::DOUBLE ELSE 5.0::DOUBLE END END AS size_usdt FROM rej)"""


#: Every candle taken as a position, long on even hours and short on odd ones: exits, holding time and gross result.
POSITIONS = INDICATORS + """,
pe AS (SELECT *, CASE WHEN ts // 3600000 % 2 = 0 THEN 1 ELSE -1 END AS k FROM ind),
pp AS (SELECT *, close * CASE WHEN k = 1 THEN 1.0005::DOUBLE ELSE 0.9995::DOUBLE END AS fill, round(close + k * atr14 * 1.6::DOUBLE, 8) AS tp, round(close - k * atr14, 8) AS sl FROM pe),
pq AS (SELECT *, fill * CASE WHEN k = 1 THEN 1 - 1.0::DOUBLE / 20 + 0.005::DOUBLE ELSE 1 + 1.0::DOUBLE / 20 - 0.005::DOUBLE END AS liq,
  list({'ts': ts, 'h': high, 'l': low, 'c': close}) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM pp),
pm AS (SELECT *, list_filter(list_transform(coalesce(ahead, []), lambda b: {'ts': b.ts, 'why': CASE WHEN k = 1 THEN CASE WHEN b.h >= tp THEN 'take_profit' WHEN b.l <= sl THEN 'stop_loss' WHEN b.l <= liq THEN 'liquidated' END
  ELSE CASE WHEN b.l <= tp THEN 'take_profit' WHEN b.h >= sl THEN 'stop_loss' WHEN b.h >= liq THEN 'liquidated' END END}), lambda b: b.why IS NOT NULL) AS met FROM pq),
pr AS (SELECT *, CASE WHEN len(met) > 0 THEN met[1].why ELSE 'timeout' END AS close_reason,
  CASE WHEN len(met) > 0 THEN met[1].ts WHEN len(coalesce(ahead, [])) > 0 THEN ahead[-1].ts ELSE ts END AS exit_ts FROM pm),
px AS (SELECT *, CASE close_reason WHEN 'take_profit' THEN tp WHEN 'stop_loss' THEN sl WHEN 'liquidated' THEN liq ELSE coalesce(ahead[-1].c, close) END * CASE WHEN k = 1 THEN 0.9995::DOUBLE ELSE 1.0005::DOUBLE END AS price FROM pr),
position AS (SELECT pair, ts, k, close_reason, exit_ts, CAST(greatest((exit_ts - ts) // 900000, 1) AS INTEGER) AS hold_candles, CASE WHEN fill > 0 THEN k * (price - fill) / fill * 200 END AS gross FROM px)"""


def remembered(p: Params, trades: str) -> str:
    """The scan's choice with the memory of ``trades`` (table expressions that end in ``past``) closed before each candle."""
    know = ", ".join(f"(SELECT {{'n': count(*), 'wr': round(count(*) FILTER (WHERE t.pnl > 0)::DOUBLE / nullif(count(*), 0), 4)}} FROM past t WHERE t.pattern = '{name}' AND t.direction = det.trend AND t.exit_ts < det.ts) AS m_{s}"
                     for s, name, _ in DETECTORS)
    cands = ", ".join(
        f"CASE WHEN d_{s} = trend AND regime IN {r} AND (session <> 'overlap' OR '{name}' = 'compression_breakout') AND NOT coalesce(m_{s}.n >= 20 AND m_{s}.wr < 0.35::DOUBLE, false) THEN "
        f"{{'confidence': round(CASE WHEN m_{s}.n >= 10 THEN round(greatest(0.3::DOUBLE, least(0.95::DOUBLE, c_{s} * 0.7::DOUBLE + m_{s}.wr * 0.3::DOUBLE)), 3) ELSE c_{s} END / (CASE WHEN session = 'asian' THEN 1.1 ELSE 1.0 END)::DOUBLE, 3), "
        f"'ord': {-k}, 'pattern': '{name}', 'direction': d_{s}}} END" for k, (s, name, r) in enumerate(DETECTORS))
    return signals(p).replace(INDICATORS, trades).replace(f"list_max(list_filter([{_cands}]", f"list_max(list_filter([{cands}]").replace("AS best FROM det)", f"AS best FROM (SELECT *, {know} FROM det))")


def simulation(p: Params, folds: bool = False) -> str:
    """Exits of all candles, and the walk over candidates: one position at a time, daily loss limit.

    A candidate's successors, whether it is taken or not, are found beforehand,
    so each step of the recursion is one look-up.
    """
    hold = p.max_hold_candles
    return signals(p, folds) + f""",
fill AS (SELECT *, round(close, 8) AS entry, round(close, 8) * CASE WHEN side = 'long' THEN 1.0005::DOUBLE ELSE 0.9995::DOUBLE END AS fill, size_usdt * 20 AS notional FROM sig),
liq AS (SELECT *, fill * CASE WHEN side = 'long' THEN 1 - 1.0::DOUBLE / 20 + 0.005::DOUBLE ELSE 1 + 1.0::DOUBLE / 20 - 0.005::DOUBLE END AS liquidation_price,
  CASE WHEN outcome = 'fired' THEN CASE WHEN abs(sl_price - entry) = 0 THEN 'sl_distance_zero' WHEN abs(tp_price - entry) / abs(sl_price - entry) < 1.2::DOUBLE THEN 'rr_below_minimum'
    WHEN abs(tp_price - entry) / nullif(entry, 0) * 100 <= (0.04::DOUBLE + 0.04::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE) * 1.5::DOUBLE THEN 'fee_not_viable' END END AS risk_reason,
  max(rn) OVER (PARTITION BY pair) AS last_rn,
  coalesce(list({{'rn': rn, 'ts': ts, 'h': high, 'l': low, 'c': close}}) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {hold} FOLLOWING), []) AS ahead FROM fill),
bars AS (SELECT *, list_filter(list_transform(ahead, lambda b: {{'rn': b.rn, 'ts': b.ts, 'why': CASE WHEN side = 'long' THEN CASE WHEN b.h >= tp_price THEN 'take_profit' WHEN b.l <= sl_price THEN 'stop_loss' WHEN b.l <= liquidation_price THEN 'liquidated' END
  ELSE CASE WHEN b.l <= tp_price THEN 'take_profit' WHEN b.h >= sl_price THEN 'stop_loss' WHEN b.h >= liquidation_price THEN 'liquidated' END END}}), lambda b: b.why IS NOT NULL) AS hits FROM liq),
ends AS (SELECT *, CASE WHEN len(hits) > 0 THEN hits[1].why ELSE 'timeout' END AS close_reason, len(hits) = 0 AND len(ahead) < {hold} AS forced,
  CASE WHEN len(hits) > 0 THEN hits[1].rn WHEN len(ahead) > 0 THEN ahead[-1].rn ELSE rn END AS exit_rn, CASE WHEN len(hits) > 0 THEN hits[1].ts WHEN len(ahead) > 0 THEN ahead[-1].ts ELSE ts END AS exit_ts FROM bars),
paid AS (SELECT *, CASE close_reason WHEN 'take_profit' THEN tp_price WHEN 'stop_loss' THEN sl_price WHEN 'liquidated' THEN liquidation_price ELSE coalesce(ahead[-1].c, close) END
  * CASE WHEN side = 'long' THEN 0.9995::DOUBLE ELSE 1.0005::DOUBLE END AS price FROM ends),
sim AS (SELECT *, (CASE WHEN side = 'long' THEN price - fill ELSE fill - price END) / fill * notional AS gross, notional * 0.0004::DOUBLE AS fee,
  (CASE WHEN side = 'long' THEN price - fill ELSE fill - price END) / fill * notional - 2 * notional * 0.0004::DOUBLE AS net,
  CASE WHEN forced THEN last_rn + 1 ELSE exit_rn END AS free_rn, ts - ts % 86400000 AS day, exit_ts - exit_ts % 86400000 AS exit_day FROM paid WHERE rn > 60),
cand AS (SELECT pair, rn, free_rn, day, exit_day, round(net, 6) AS pnl FROM sim WHERE outcome = 'fired' AND risk_reason IS NULL),
hop AS (SELECT a.pair, a.rn, a.free_rn, a.day, a.exit_day, a.pnl, min(b.rn) FILTER (WHERE b.rn >= a.free_rn) AS if_taken, min(b.rn) AS if_not
        FROM cand a LEFT JOIN cand b ON b.pair = a.pair AND b.rn > a.rn GROUP BY ALL),
walk AS (SELECT h.pair, h.rn, h.free_rn AS free, h.exit_day AS book_day, h.pnl AS book, true AS taken, if_taken AS next FROM hop h JOIN (SELECT pair, min(rn) AS rn FROM cand GROUP BY pair) USING (pair, rn)
  UNION ALL
  SELECT h.pair, h.rn, CASE WHEN ok THEN h.free_rn ELSE h.free END, CASE WHEN ok THEN h.exit_day ELSE h.book_day END, CASE WHEN ok THEN CASE WHEN h.book_day = h.exit_day THEN h.book ELSE 0 END + h.pnl ELSE h.book END,
         ok, CASE WHEN ok THEN if_taken ELSE if_not END
  FROM (SELECT x.*, w.free, w.book_day, w.book, CASE WHEN w.book_day = x.day THEN w.book ELSE 0 END > -5 AS ok FROM walk w JOIN hop x ON x.pair = w.pair AND x.rn = w.next) h),
fate AS (SELECT s.*, w.taken, coalesce(max(CASE WHEN w.taken THEN s.free_rn END) OVER (PARTITION BY s.pair ORDER BY s.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s.rn, false) AS held
         FROM sim s LEFT JOIN walk w ON w.pair = s.pair AND w.rn = s.rn)"""


GATES, PATTERNS, SIGNALS = gates(P), patterns(P), signals(P)

def met(by: str, order: str) -> str:
    """Metrics of the trades in ``closed``."""
    run = f"PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING"
    return f"""
eq AS (SELECT *, sum(pnl_net_usdt) OVER r AS equity FROM closed WINDOW r AS ({run})),
dd AS (SELECT *, greatest(max(equity) OVER r, 0) AS peak FROM eq WINDOW r AS ({run})),
met AS (SELECT {by}, count(*) AS total_trades, count(*) FILTER (WHERE pnl_net_usdt > 0) AS win_count, count(*) FILTER (WHERE pnl_net_usdt <= 0) AS loss_count,
               count(*) FILTER (WHERE pnl_net_usdt > 0) / count(*) AS win_rate, sum(pnl_net_usdt) AS total_pnl_usdt, avg(pnl_net_usdt) AS avg_pnl_usdt,
               coalesce(avg(pnl_net_usdt) FILTER (WHERE pnl_net_usdt > 0), 0) AS avg_win_usdt, coalesce(avg(pnl_net_usdt) FILTER (WHERE pnl_net_usdt <= 0), 0) AS avg_loss_usdt,
               avg(hold_candles) AS avg_hold_candles, coalesce(sum(pnl_net_usdt) FILTER (WHERE pnl_net_usdt > 0), 0) / nullif(abs(sum(pnl_net_usdt) FILTER (WHERE pnl_net_usdt <= 0)), 0) AS profit_factor,
               CASE WHEN count(*) >= 2 AND stddev_samp(pnl_pct) > 0 THEN avg(pnl_pct) / stddev_samp(pnl_pct) * sqrt(105120) ELSE 0 END AS sharpe_ratio,
               max(peak - equity) AS max_drawdown_usdt, CASE WHEN max(peak) > 0 THEN max(peak - equity) / max(peak) * 100 ELSE 0 END AS max_drawdown_pct FROM dd GROUP BY {by})"""


#: Metrics with a value, 0, where a group has no trades.
FILLED = ("win_rate", "total_pnl_usdt", "avg_pnl_usdt", "avg_win_usdt", "avg_loss_usdt", "avg_hold_candles", "sharpe_ratio", "max_drawdown_usdt", "max_drawdown_pct")


def walk_forward(p: Params) -> str:
    """Metrics of the backtest on either side of the split, as a whole statement."""
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("total_trades", "win_count", "loss_count", *FILLED))
    return query(simulation(p, True), f""",
closed AS (SELECT split_part(pair, '|', 1) AS pair, split_part(pair, '|', 2) AS fold, ts AS entry_ts, exit_ts, round(net, 6) AS pnl_net_usdt, round(net / size_usdt * 100, 4) AS pnl_pct,
                  greatest((exit_ts - ts) // 900000, 1) AS hold_candles FROM fate WHERE taken),{met('pair, fold', 'exit_ts, entry_ts')}
SELECT pair, fold, {zero}, profit_factor FROM (SELECT DISTINCT split_part(pair, '|', 1) AS pair, split_part(pair, '|', 2) AS fold FROM fate) LEFT JOIN met USING (pair, fold)""")


def compared(baseline: str, candidate: str) -> str:
    """Table expressions that judge each metric of two tables of metrics per pair."""
    rows = ", ".join(f"{{'m': '{m}', 'u': {1 if up else -1}, 'b': {baseline}.{m}, 'c': {candidate}.{m}}}" for m, up in COMPARED.items())
    return f"""
x AS (SELECT {baseline}.pair, unnest([{rows}]) AS z FROM {baseline} JOIN {candidate} USING (pair)),
g AS (SELECT pair, z.m AS metric, z.b AS baseline, z.c AS candidate, z.u * (z.c - z.b) / abs(nullif(z.b, 0)) AS gain FROM x),
j AS (SELECT pair, metric, baseline, candidate, CASE WHEN gain IS NULL THEN 'hold' WHEN gain >= 0 THEN 'improve' WHEN gain < -0.05 THEN 'regress' ELSE 'hold' END AS result FROM g),
judged AS (SELECT *, CASE WHEN bool_or(result = 'regress') OVER (PARTITION BY pair) THEN 'REJECT' ELSE 'ACCEPT' END AS verdict FROM j)"""


def trials(sets: dict[str, Params]) -> str:
    """Every set against the one called baseline, one whole walk-forward each."""
    names = [n for n in sets if n != "baseline"]
    each = ",\n".join(f"{'b' if n == 'baseline' else 'c_' + n} AS (SELECT * FROM ({walk_forward(p)}) WHERE fold = 'out_sample')" for n, p in sets.items())
    candidates = " UNION ALL ".join(f"SELECT * REPLACE (pair || '|{n}' AS pair) FROM c_{n}" for n in names)
    return (f"WITH {each},\nbase AS (SELECT b.* REPLACE (b.pair || '|' || t.n AS pair) FROM b, (SELECT unnest({names}) AS n) t), cand AS ({candidates}),{compared('base', 'cand')}\n"
            "SELECT split_part(pair, '|', 1) AS pair, split_part(pair, '|', 2) AS trial, metric, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, result, verdict, "
            "CASE verdict WHEN 'ACCEPT' THEN split_part(pair, '|', 2) ELSE 'baseline' END AS kept FROM judged")


TRADES = """
trades AS (SELECT o_orderkey AS trade_id, 'dev-bot' AS bot_id, 'dev' AS env, o_orderpriority AS pair, '1h' AS timeframe, CASE WHEN o_custkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
                  CASE o_custkey % 3 WHEN 0 THEN 'wick_rejection' WHEN 1 THEN 'anomaly_fade' ELSE 'impulse_retracement' END AS pattern,
                  epoch_ms(o_orderdate) + (o_orderkey % 24) * 3600000 AS entry_ts, o_totalprice AS entry_price,
                  CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + (o_orderkey % 24 + 1 + o_custkey % 48) * 3600000 END AS exit_ts,
                  CASE WHEN o_orderstatus <> 'O' THEN (o_totalprice - 150000.0::DOUBLE) / 10000.0::DOUBLE END AS pnl_net_usdt,
                  CASE WHEN o_orderstatus <> 'O' THEN (o_totalprice - 150000.0::DOUBLE) / 1000.0::DOUBLE END AS pnl_pct,
                  CASE WHEN o_orderstatus <> 'O' THEN CAST(1 + o_custkey % 48 AS INTEGER) END AS hold_candles,
                  CASE WHEN o_orderstatus <> 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'take_profit' WHEN 1 THEN 'stop_loss' WHEN 2 THEN 'timeout' END END AS close_reason FROM orders),
tsess AS (SELECT *, CASE WHEN (entry_ts // 3600000) % 24 BETWEEN 13 AND 15 THEN 'overlap' WHEN (entry_ts // 3600000) % 24 BETWEEN 8 AND 12 THEN 'london'
                    WHEN (entry_ts // 3600000) % 24 BETWEEN 16 AND 20 THEN 'us' ELSE 'asian' END AS session,
                 CASE trade_id % 3 WHEN 0 THEN 'TRENDING' WHEN 1 THEN 'RANGING' ELSE 'VOLATILE' END AS regime FROM trades),
closed AS (SELECT * FROM tsess WHERE exit_ts IS NOT NULL),""" + met("pair", "exit_ts, trade_id")


def query(ctes: str, select: str) -> str:
    """One statement; ``select`` may begin with a comma and more table expressions."""
    ctes = ("RECURSIVE " if "\nwalk AS" in ctes else "") + ctes.strip()
    return f"WITH {ctes.strip()}{select}" if select.startswith(",") else f"WITH {ctes.strip()}\n{select}"


def half_up(x: str, places: int) -> str:
    """A double rounded by its decimal text, ties away from zero."""
    return f"CAST(CAST(({x})::DOUBLE AS VARCHAR)::DECIMAL(38, {places}) AS DOUBLE)"


def r8(*columns: str) -> str:
    return ", ".join(f"round({c}, 8) AS {c.split('.')[-1]}" for c in columns)
