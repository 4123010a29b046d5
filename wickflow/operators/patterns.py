"""Pattern detectors: a registry of functions from parameters to a struct column.

A detector returns a column of type struct(direction, confidence, details), null
where the pattern doesn't fire. Registration order breaks ties. Detectors read
lagged columns that ``with_lags`` adds, so a scan of all of them shares one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.functions.candle import ratio
from wickflow.operators.frames import LAGGED, lags_of
from wickflow.operators.indicators import frame, ordered
from wickflow.params import Params

Detector = Callable[[Params], Column]
REGISTRY: dict[str, Detector] = {}


def pattern(name: str) -> Callable[[Detector], Detector]:
    """Register a detector under a name; the extension point for own patterns."""

    def add(f: Detector) -> Detector:
        REGISTRY[name] = f
        return f

    return add


def with_lags(df: DataFrame, params: Params = Params()) -> DataFrame:
    """Lags, frame extremes and prior-frame statistics that the detectors read, where the frames' pass has not made them."""
    if f"open_{lags_of(params)}" in df.columns:
        return df
    w = ordered(df)
    lags = {f"{c}_{k}": F.lag(c, k).over(w) for c in LAGGED for k in range(1, lags_of(params) + 1)}
    prev10, prev20 = frame(df, 10, -1), frame(df, 20, -1)
    return df.withColumns(lags | {
        "low10": F.min("low").over(prev10), "high10": F.max("high").over(prev10),
        "vma_prev": F.avg("volume").over(prev20), "vsd_prev": F.stddev_pop("volume").over(prev20)})


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _long(direction: str) -> Column:
    return F.col(direction) == "bullish"


#: Details that are price levels, to two places; all others have three.
_LEVELS = ("level", "bb_upper", "bb_lower")


def _fired(when: Column, direction: Column, confidence: Column, **details: Column) -> Column:
    details = {k: F.round(v.cast("double"), 2 if k in _LEVELS else 3) for k, v in details.items()}
    return F.when(when, F.struct(direction.alias("direction"), F.round(confidence, 3).alias("confidence"),
                                 F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("double"))]).alias("details")))


@pattern("impulse_retracement")
def impulse_retracement(p: Params) -> Column:
    """A strong candle on volume, then a partial pullback on less."""
    c = F.col
    share = ratio(c("body_size"), c("body_size_1"))
    up = _long("direction_1")
    ok = _all(c("n") >= 3, c("body_ratio_1") >= p.body_ratio_min, c("volume_ratio_1") >= p.volume_ratio_min, c("body_size_1") > 0,
              share.between(p.retracement_min, p.retracement_max), c("volume") < c("volume_1"), c("direction") != c("direction_1"),
              F.when(up, c("close") >= c("open_1")).otherwise(c("close") <= c("open_1")))
    conf = F.least(0.4 + c("body_ratio_1") * 0.3 + F.least(c("volume_ratio_1") / p.volume_ratio_min - 1.0, F.lit(0.3)), F.lit(1.0))
    return _fired(ok, F.when(up, "long").otherwise("short"), conf, trigger_body_ratio=c("body_ratio_1"), trigger_vol_ratio=c("volume_ratio_1"), retrace_frac=share)


@pattern("wick_rejection")
def wick_rejection(p: Params) -> Column:
    """A long wick at a recent extreme with the close at the other end; long is tried first."""
    c = F.col
    place = ratio(c("close") - c("low"), c("total_range"))
    low_wick, high_wick = ratio(c("lower_wick"), c("body_size")), ratio(c("upper_wick"), c("body_size"))
    base = _all(c("n") >= 3, c("atr14_w") != 0, c("body_size") != 0, c("total_range") != 0)
    up = _all(low_wick >= p.wick_ratio_min, place >= 0.70, F.abs(c("low") - c("low10")) <= c("atr14_w"))
    down = _all(high_wick >= p.wick_ratio_min, place <= 0.30, F.abs(c("high") - c("high10")) <= c("atr14_w"))
    conf = lambda wick, pos: F.least(0.45 + (wick - p.wick_ratio_min) * 0.1 + pos * 0.15, F.lit(1.0))
    long = _fired(base & up, F.lit("long"), conf(low_wick, place), wick_ratio=low_wick, close_position=place, level=c("low10"))
    short = _fired(base & down, F.lit("short"), conf(high_wick, 1.0 - place), wick_ratio=high_wick, close_position=place, level=c("high10"))
    return F.coalesce(long, short)


@pattern("compression_breakout")
def compression_breakout(p: Params) -> Column:
    """Shrinking ranges, bands and volume, then a close outside the bands on volume."""
    c = F.col
    widths = [c("bb_width"), *[c(f"bb_width_{k}") for k in range(1, 5)]]
    ok = _all(c("n") >= 25, c("tr20") != 0, c("tr5") < c("tr20") * p.compression_factor, *[old >= new for new, old in zip(widths, widths[1:])],
              c("volume_3") >= c("volume_2"), c("volume_2") >= c("volume_1"), c("volume_ratio") >= 1.5, (c("close") > c("bb_upper")) | (c("close") < c("bb_lower")))
    conf = F.least(0.50 + (c("volume_ratio") - 1.5) * 0.1, F.lit(0.95))
    return _fired(ok, F.when(c("close") > c("bb_upper"), "long").otherwise("short"), conf, atr5_atr20_ratio=ratio(c("tr5"), c("tr20")),
                  vol_ratio=c("volume_ratio"), bb_upper=c("bb_upper"), bb_lower=c("bb_lower"))


@pattern("momentum_continuation")
def momentum_continuation(p: Params) -> Column:
    """N candles one way with growing bodies and volumes, then a small counter candle."""
    hits = [(n, _momentum(p, n)) for n in p.values("momentum_acceleration_candles")]
    return hits[0][1] if len(hits) == 1 else F.coalesce(*[F.when(p.momentum_acceleration_candles == n, hit) for n, hit in hits])


def _momentum(p: Params, n: int) -> Column:
    c = F.col
    back = range(n, 0, -1)  # oldest first
    grows = lambda x: [c(f"{x}_{a}") <= c(f"{x}_{b}") for a, b in zip(back, list(back)[1:])]
    ok = _all(c("n") >= n + 2, *[c(f"direction_{k}") == c("direction_1") for k in back], *grows("body_size"), *grows("volume"),
              c("body_size_1") != 0, c("body_size") < 0.4 * c("body_size_1"), c("volume") < c("volume_1"), c("direction") != c("direction_1"))
    growth = ratio(c("body_size_1"), c(f"body_size_{n}"), 1.0)
    return _fired(ok, F.when(_long("direction_1"), "long").otherwise("short"), F.least(0.50 + growth * 0.05 + n * 0.03, F.lit(0.95)),
                  setup_candles=F.lit(n), body_growth=growth, retrace_body_ratio=ratio(c("body_size"), c("body_size_1")))


@pattern("anomaly_fade")
def anomaly_fade(p: Params) -> Column:
    """A spike in volume and price, faded once the next close turns back."""
    c = F.col
    move = F.abs(c("close_1") - c("open_1"))
    up = _long("direction_1")
    ok = _all(c("n") >= 22, c("atr14_prev") != 0, c("volume_1") >= c("vma_prev") + p.anomaly_volume_stddev * c("vsd_prev"), move >= p.anomaly_price_atr * c("atr14_prev"),
              F.when(up, c("close") < c("close_1")).otherwise(c("close") > c("close_1")))
    times = ratio(c("volume_1"), c("vma_prev"), 1.0)
    return _fired(ok, F.when(up, "short").otherwise("long"), F.least(0.50 + (times - 1.0) * 0.05, F.lit(0.95)),
                  spike_vol_ratio=times, spike_move_atr=ratio(move, c("atr14_prev")))


@lru_cache(maxsize=256)
def _column(detector: Detector, params: Params) -> Column:
    """A detector's column, which depends on its parameters alone: built once, since a build takes longer than a small run."""
    return detector(params)


def detect(df: DataFrame, params: Params = Params(), names: tuple[str, ...] | None = None) -> DataFrame:
    """Add one struct column per pattern; the frame's lags are computed once."""
    df = with_lags(df, params)
    kept = df.columns
    return df.withColumns({f"p_{k}": _column(REGISTRY[k], params) for k in names or tuple(REGISTRY)}).drop(*[x for x in kept if x.rsplit("_", 1)[-1].isdigit() and x.rsplit("_", 1)[0] in LAGGED])
