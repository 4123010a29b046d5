"""Stored indicators kept where they stand and recomputed only where they are missing.

A missing value needs the rows of its frame. Days are counted first; a day with a
gap asks for itself and the days before it that supply a frame. Only those days
are read again and go through the frames' pass; rows of all other days are
passed on as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.operators.frames import FRAME
from wickflow.operators.indicators import indicators
from wickflow.params import Params
from wickflow.schemas import DAY_MS, SERIES
from wickflow.scratch import materialise

#: The indicators that a candle stores.
NAMES = ("ema9", "ema21", "rsi14", "atr14", "bb_upper", "bb_lower", "bb_width", "adx", "volume_ma20", "volume_ratio")


def gap(names: tuple[str, ...] = NAMES) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])


def needed_days(stored: DataFrame, names: tuple[str, ...] = NAMES, buffer: int = FRAME) -> DataFrame:
    """series, day and ``own`` (it has gaps) of the days that have to be read: those with gaps, and before them days with at least a frame's rows.

    One row per series and day at most; the tables it is made of are as small.
    """
    day = F.floor(F.col("ts") / DAY_MS).alias("day")
    days = stored.groupBy(*SERIES, day).agg(F.count(F.lit(1)).alias("n"), F.max(gap(names)).alias("own"))
    series = Window.partitionBy(*SERIES).orderBy("day")
    days = days.withColumn("before", F.coalesce(F.sum("n").over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The rows before the next day with a gap: a day serves it if its last row is within a frame of that day's first.
    later = F.min(F.when(F.col("own"), F.col("before"))).over(series.rowsBetween(1, Window.unboundedFollowing))
    serves = F.col("own") | F.coalesce(F.col("before") + F.col("n") > later - (buffer - 1), F.lit(False))
    return days.withColumn("serves", serves).filter("serves").select(*SERIES, "day", "own")


def fill_missing(stored: DataFrame, params: Params = Params(), names: tuple[str, ...] = NAMES, buffer: int = FRAME) -> DataFrame:
    """``stored`` candles with their null indicators filled; stored values win over recomputed ones.

    A value whose frame holds a null price stays null.
    """
    days = materialise(needed_days(stored, names, buffer), "repair-days")
    if not days.limit(1).count():
        return stored
    dated = stored.withColumn("day", F.floor(F.col("ts") / DAY_MS))
    again = dated.join(days, [*SERIES, "day"])
    kept = again.withColumns({f"old_{c}": F.col(c) for c in names})
    made = indicators(kept.drop(*names), params, buffer, only=names).filter("own")
    filled = made.withColumns({c: F.coalesce(F.col(f"old_{c}"), F.col(c)) for c in names}).select(*stored.columns)
    whole = dated.join(days.filter("own"), [*SERIES, "day"], "left_anti").select(*stored.columns)
    return whole.unionByName(filled)
