"""Rolling indicators: every value is a function of a bounded row frame.

By default all of them come from the Arrow pass of ``frames``: one exchange and
one sort. ``native`` says the same by window aggregates and folds with scalar
accumulators. ``chunks`` cuts long series into pieces with enough rows before
them, so one series doesn't bound the parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.candle import ratio
from wickflow.operators.frames import FRAME, STORED, compute, fields, over_series
from wickflow.params import Params
from wickflow.schemas import DAY_MS, SERIES

#: Rows a chunk of a long series aims at.
CHUNK_ROWS = 500_000


def keys(df: DataFrame) -> list[str]:
    """Partition columns of a series' windows: fold, chunk and trial too where they exist."""
    return [*SERIES, *[c for c in ("fold", "chunk", "trial") if c in df.columns]]


def frame(df: DataFrame, n: int, end: int = 0):
    return Window.partitionBy(*keys(df)).orderBy("ts").rowsBetween(end - n + 1 if end == 0 else -n, end)


def ordered(df: DataFrame):
    return Window.partitionBy(*keys(df)).orderBy("ts")


def chunks(df: DataFrame, look_back: int, rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with ``chunk`` and ``own``: each chunk also holds, not as its own, the
    days before it that supply at least ``look_back`` rows.

    Days are counted first (pre-aggregated); the day table decides the cuts.
    """
    day = F.floor(F.col("ts") / DAY_MS).alias("day")
    days = df.groupBy(*SERIES, day).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*SERIES).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    days = days.withColumn("chunk", F.floor(F.col("before") / rows))
    first = days.groupBy(*SERIES, "chunk").agg(F.min("before").alias("from_row"), F.min("day").alias("first_day"))
    # A day serves a later chunk if it ends within look_back rows of that chunk's first row.
    serves = days.select(*SERIES, "day", "before", "n", "chunk").join(
        first.withColumnRenamed("chunk", "to").drop("first_day"), list(SERIES)).filter(
        (F.col("to") == F.col("chunk")) | (F.col("to") > F.col("chunk")) & (F.col("before") + F.col("n") > F.col("from_row") - look_back))
    serves = serves.select(*SERIES, "day", F.col("to").alias("chunk"), (F.col("to") == F.col("chunk")).alias("own"))
    return df.withColumn("day", F.floor(F.col("ts") / DAY_MS)).join(serves, [*SERIES, "day"]).drop("day")


def ema(values: Column, p: int) -> Column:
    """EMA over a frame's values: mean while shorter than p, else seeded by the first p."""
    k = 2.0 / (p + 1)
    n = F.size(values)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    seed = total(F.slice(values, 1, p)) / p
    return F.when(n == 0, 0.0).when(n < p, total(values) / n).otherwise(
        F.aggregate(F.slice(values, p + 1, F.greatest(n - p, F.lit(0))), seed, lambda a, x: x * k + a * (1.0 - k)))


def wilder(values: Column, p: int) -> Column:
    """Wilder average over a frame's values; plain mean while shorter than p."""
    n = F.size(values)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    seed = total(F.slice(values, 1, p)) / p
    return F.when(n == 0, 0.0).when(n < p, total(values) / n).otherwise(
        F.aggregate(F.slice(values, p + 1, F.greatest(n - p, F.lit(0))), seed, lambda a, x: (a * (p - 1) + x) / p))


def rsi(deltas: Column, p: int = 14) -> Column:
    gain = F.transform(deltas, lambda d: F.greatest(d, F.lit(0.0)))
    loss = F.transform(deltas, lambda d: F.greatest(-d, F.lit(0.0)))
    g, lo = wilder(gain, p), wilder(loss, p)
    return F.when(F.size(deltas) < p, 50.0).otherwise(F.when(lo == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + g / F.when(lo != 0, lo))))


def adx(moves: Column, p: int = 14) -> Column:
    """ADX over a frame's (tr, up, down) moves in one pass with scalar state.

    The state is the number of moves, their smoothed sums, and ``v``: the sum of
    DX until there are p of them, the average from then on. A step first books
    the DX of the sums it finds, so that DX is an expression of plain fields.
    Both DI share their denominator, which leaves DX = 100 |u - d| / (u + d).
    """
    zero = F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(k) for k in ("t", "u", "d", "v")])

    def booked(a: Column) -> Column:
        dx = F.when((a["t"] != 0) & (a["u"] + a["d"] != 0), 100.0 * F.abs(a["u"] - a["d"]) / (a["u"] + a["d"])).otherwise(0.0)
        return F.when(a["n"] < p, 0.0).when(a["n"] < 2 * p - 1, a["v"] + dx).when(a["n"] == 2 * p - 1, (a["v"] + dx) / p).otherwise((a["v"] * (p - 1) + dx) / p)

    def step(a: Column, x: Column) -> Column:
        grown = [F.when(a["n"] < p, a[k] + x[v]).otherwise(a[k] - a[k] / p + x[v]).alias(k) for k, v in (("t", "tr"), ("u", "up"), ("d", "down"))]
        return F.struct((a["n"] + 1).alias("n"), *grown, booked(a).alias("v"))

    def last(a: Column) -> Column:
        few = F.greatest(a["n"] - (p - 1), F.lit(1))
        return F.when(a["n"] < 2 * p - 1, booked(a) / few).otherwise(booked(a))

    return F.when(F.size(moves) < p, 0.0).otherwise(F.aggregate(moves, zero, step, last))


def moves(df: DataFrame) -> DataFrame:
    """Row number in the series, true range, directional moves and close delta (0 on the first row)."""
    w = ordered(df)
    pc, ph, pl = (F.lag(c).over(w) for c in ("close", "high", "low"))
    up, down = F.col("high") - ph, pl - F.col("low")
    return df.withColumns({
        "rn": F.row_number().over(w),
        "tr": F.when(pc.isNull(), 0.0).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))),
        "up": F.when((up > down) & (up > 0), up).otherwise(0.0), "down": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "delta": F.coalesce(F.col("close") - pc, F.lit(0.0)),
    })


def rest_of(array: Column) -> Column:
    """A frame without its first row, whose moves look outside the frame."""
    return F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0)))


def indicators(df: DataFrame, params: Params = Params(), buffer: int = FRAME, native: bool = False, only: tuple[str, ...] = STORED) -> DataFrame:
    """Add the indicator columns to candles, or those of them in ``only``; names are fixed although periods are parameters."""
    if not native:
        # Only prices, volumes and what the rows carry are read, so nothing else is asked of the pass.
        return over_series(df, keys(df), buffer, fields(params, only, False), lambda b, first, number: compute(b, first, number, params, buffer, None, only))
    df = moves(df).withColumn("w", F.collect_list(F.struct("close", "tr", "up", "down", "delta")).over(frame(df, buffer)))
    closes = F.col("w.close")
    df = df.withColumns({"ema9": ema(closes, params.ema_fast), "ema21": ema(closes, params.ema_slow), "rsi14": rsi(rest_of(F.col("w.delta"))),
                         "atr14": wilder(rest_of(F.col("w.tr")), 14), "adx": adx(rest_of(F.col("w")))}).drop("w")
    w20 = frame(df, 20)
    n20 = F.count(F.lit(1)).over(w20)
    df = df.withColumns({
        "sma20": F.avg("close").over(w20), "sd20": F.stddev_pop("close").over(w20), "n20": n20, "volume_ma20": F.avg("volume").over(w20),
        "volume_sd20": F.when(n20 < 2, 0.0).otherwise(F.stddev_pop("volume").over(w20)),
    })
    wide = F.col("n20") >= 20
    df = df.withColumns({
        "bb_upper": F.col("sma20") + F.when(wide, 2.0 * F.col("sd20")).otherwise(0.0), "bb_lower": F.col("sma20") - F.when(wide, 2.0 * F.col("sd20")).otherwise(0.0),
        "volume_ratio": ratio(F.col("volume"), F.col("volume_ma20"), 1.0),
    })
    width = F.when(wide & (F.col("sma20") != 0), (F.col("bb_upper") - F.col("bb_lower")) / F.when(F.col("sma20") != 0, F.col("sma20"))).otherwise(0.0)
    return df.withColumn("bb_width", width).drop("sd20", "n20", "sma20")


def window_ranges(df: DataFrame, window: int = FRAME, native: bool = False, params: Params = Params(), lags: bool = True) -> DataFrame:
    """Moves, the ATR variants that detectors recompute on the evaluation window, and (not natively) extremes, the trend's streak and, for candles with geometry, lags."""
    if not native:
        lags = lags and "body_size" in df.columns
        return over_series(df, keys(df), window, fields(params, None, True, lags), lambda b, first, number: compute(b, first, number, params, window, window, None, lags))
    df = moves(df)
    df = df.withColumns({"wt": F.collect_list("tr").over(frame(df, window)), "pt": F.collect_list("tr").over(frame(df, window - 1, -1))})
    rest, prior = rest_of(F.col("wt")), rest_of(F.col("pt"))
    df = df.withColumns({"atr14_w": wilder(rest, 14), "atr50_w": wilder(rest, 50), "atr14_prev": wilder(prior, 14)}).drop("wt", "pt")
    return df.withColumns({"tr5": F.avg("tr").over(frame(df, 5)), "tr20": F.avg("tr").over(frame(df, 20)), "n": F.least(F.col("rn"), F.lit(window)),
                           "atr50_w": F.when(F.col("rn") >= 51, F.col("atr50_w"))})


def framed(df: DataFrame, params: Params = Params(), buffer: int = FRAME, window: int = FRAME, lags: bool = True) -> DataFrame:
    """``indicators`` and ``window_ranges`` of candles with geometry in one pass."""
    return over_series(df, keys(df), buffer + window, fields(params, STORED, True, lags), lambda b, first, number: compute(b, first, number, params, buffer, window, STORED, lags))
