"""All columns of candles that depend on a row frame, in one Arrow pass over sorted series.

The pass sorts each series once and yields stored indicators, the ranges that
detectors recompute on their window, lags, extremes and the trend's streak, so
what follows is projections. The stream's keyed state calls the same functions
on its ring of rows. A frame that holds a null price or volume gives null, a
later frame is whole again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wickflow.operators.rolling import Spec, kernel, moves_of
from wickflow.params import Params
from wickflow.scratch import ship

#: Rows of a live frame.
FRAME = 120
#: Columns that detectors look back at, and how far the fixed ones do.
LAGGED = ("open", "close", "volume", "body_size", "body_ratio", "volume_ratio", "bb_width", "direction")
LAGS = 4
#: Stored indicators in the order of the candle's columns, and helpers beside them.
STORED = ("ema9", "ema21", "rsi14", "atr14", "adx", "volume_ma20", "volume_sd20", "volume_ratio", "bb_upper", "bb_lower", "bb_width")
MOVES = ("tr", "up", "down", "delta")
WINDOWED = (*MOVES, "atr14_w", "atr50_w", "atr14_prev", "tr5", "tr20", "low10", "high10", "vma_prev", "vsd_prev", "streak_lo", "streak_hi")

Compute = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, pa.Array]]


def _values(block: pa.RecordBatch, name: str) -> np.ndarray:
    return block.column(name).to_numpy(zero_copy_only=False).astype(np.float64)


def _as_arrow(values: np.ndarray) -> pa.Array:
    """NaN is null."""
    return pa.array(values, pa.float64(), from_pandas=True)


class _Frame:
    """The ``n`` rows that end ``end`` rows before each row, cut at its series' first row."""

    def __init__(self, first: np.ndarray, n: int, end: int = 0) -> None:
        i = np.arange(len(first))
        self.size = np.clip(np.minimum(i + end - first + 1, n), 0, None)
        self.start = i + end - self.size + 1

    def steps(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each step's values and the rows for which it lies inside, oldest first."""
        for t in range(int(self.size.max(initial=0))):
            yield x[np.minimum(self.start + t, len(x) - 1)], t < self.size

    def mean(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for v, inside in self.steps(x):
            total = np.where(inside, total + v, total)
        return np.where(self.size > 0, total / np.maximum(self.size, 1), np.nan)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Population deviation; exactly 0 for equal values."""
        mean, squares, n = np.zeros(len(x)), np.zeros(len(x)), 0
        for v, inside in self.steps(x):
            n += 1
            delta = v - mean
            moved = mean + delta / n
            squares = np.where(inside, squares + delta * (v - moved), squares)
            mean = np.where(inside, moved, mean)
        return np.where(self.size > 0, np.sqrt(squares / np.maximum(self.size, 1)), np.nan)

    def extreme(self, x: np.ndarray, pick: np.ufunc) -> np.ndarray:
        out = np.full(len(x), np.nan)
        for v, inside in self.steps(x):
            out = np.where(inside, pick(out, v), out)
        return out


def stored(block: pa.RecordBatch, first: np.ndarray, params: Params, buffer: int, only: tuple[str, ...] = STORED) -> dict[str, pa.Array]:
    """Stored indicators of candles; of the recursive ones just those that are asked for."""
    high, low, close, volume = (_values(block, c) for c in ("high", "low", "close", "volume"))
    specs = {"ema9": Spec("ema", params.ema_fast, buffer), "ema21": Spec("ema", params.ema_slow, buffer), "rsi14": Spec("rsi", 14, buffer), "atr14": Spec("atr", 14, buffer), "adx": Spec("adx", 14, buffer)}
    out = kernel(high, low, close, first, {k: s for k, s in specs.items() if k in only})
    last20 = _Frame(first, 20)
    if {"volume_ma20", "volume_sd20", "volume_ratio"} & set(only):
        out["volume_ma20"] = last20.mean(volume)
        out["volume_sd20"] = np.where(last20.size < 2, 0.0, last20.deviation(volume))
        some = out["volume_ma20"] > 0
        out["volume_ratio"] = np.where(some, volume / np.where(some, out["volume_ma20"], 1.0), np.where(np.isnan(out["volume_ma20"]), np.nan, 1.0))
    if {"bb_upper", "bb_lower", "bb_width"} & set(only):
        mean, wide = last20.mean(close), last20.size >= 20
        band = np.where(wide, 2.0 * last20.deviation(close), 0.0)
        out["bb_upper"], out["bb_lower"] = mean + band, mean - band
        able = wide & (mean != 0)
        out["bb_width"] = np.where(able, (out["bb_upper"] - out["bb_lower"]) / np.where(able, mean, 1.0), 0.0)
    return {k: _as_arrow(v) for k, v in out.items() if k in only}


def windowed(block: pa.RecordBatch, first: np.ndarray, number: np.ndarray, params: Params, window: int, lags: bool = True) -> dict[str, pa.Array]:
    """Row numbers, moves, recomputed ranges, lags, extremes and the streak, from candles with geometry and stored indicators."""
    high, low, close, volume, fast, slow = (_values(block, c) for c in ("high", "low", "close", "volume", "ema9", "ema21"))
    moves = dict(zip(MOVES, moves_of(high, low, close, first)))
    ranges = kernel(high, low, close, first, {"atr14_w": Spec("atr", 14, window), "atr50_w": Spec("atr", 50, window), "atr14_prev": Spec("atr", 14, window - 1, -1)})
    ranges["atr50_w"] = np.where(number >= 51, ranges["atr50_w"], np.nan)
    before10, before20, before3 = _Frame(first, 10, -1), _Frame(first, 20, -1), _Frame(first, 3, -1)
    trend = np.where(np.isnan(fast) | np.isnan(slow), np.nan, np.sign(fast - slow))
    known = sum((inside & ~np.isnan(v)).astype(np.int32) for v, inside in before3.steps(trend))
    found = moves | ranges | {
        "tr5": _Frame(first, 5).mean(moves["tr"]), "tr20": _Frame(first, 20).mean(moves["tr"]), "low10": before10.extreme(low, np.fmin), "high10": before10.extreme(high, np.fmax),
        "vma_prev": before20.mean(volume), "vsd_prev": before20.deviation(volume), "streak_lo": before3.extreme(trend, np.fmin), "streak_hi": before3.extreme(trend, np.fmax)}
    out = {"rn": pa.array(number, pa.int32()), "n": pa.array(np.minimum(number, window), pa.int32())} | {k: _as_arrow(found[k]) for k in WINDOWED}
    out["streak_n"] = pa.array(np.broadcast_to(known, len(first)), pa.int32())
    if lags:
        i = np.arange(len(first))
        for k in range(1, lags_of(params) + 1):
            at = pa.array(np.maximum(i - k, 0), mask=i - k < first)
            out |= {f"{c}_{k}": block.column(c).take(at) for c in LAGGED}
    return out


def lags_of(params: Params) -> int:
    return max(LAGS, params.largest("momentum_acceleration_candles"))


def fields(params: Params, only: tuple[str, ...] | None, window: bool, lags: bool = True) -> dict[str, str]:
    """Names and types of the columns that a pass adds."""
    out = dict.fromkeys(only or (), "double")
    if window:
        out |= {"rn": "int", "n": "int"} | dict.fromkeys(WINDOWED, "double") | {"streak_n": "int"}
        if lags:
            out |= {f"{c}_{k}": "string" if c == "direction" else "double" for k in range(1, lags_of(params) + 1) for c in LAGGED}
    return out


def compute(block: pa.RecordBatch, first: np.ndarray, number: np.ndarray, params: Params, buffer: int, window: int | None, only: tuple[str, ...] | None, lags: bool = True) -> dict[str, pa.Array]:
    """Stored indicators where ``only`` names them, else the block has them; with ``window`` the evaluation's columns too."""
    out = {}
    if only:
        out = stored(block, first, params, buffer, only)
        for name, column in out.items():
            block = block.set_column(block.schema.get_field_index(name), name, column) if name in block.schema.names else block.append_column(name, column)
    if window:
        out |= windowed(block, first, number, params, window, lags)
    return out


def _changes(block: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows at which a key column differs from the row before, the first included."""
    out = np.zeros(block.num_rows, bool)
    out[0] = True
    for k in keys:
        col = block.column(k)
        same = np.asarray(pc.fill_null(pc.equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False), bool)
        nulls = col.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= ~(same | nulls[1:] & nulls[:-1])
    return out


def over_series(df: DataFrame, keys: list[str], context: int, added: dict[str, str], function: Compute) -> DataFrame:
    """``df`` with the columns ``added``, computed batch by batch over series sorted by time.

    A batch comes with the last ``context`` rows of its series before it, so a
    series of any length streams through a task.
    """
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in added]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c in kept), *(f"`{c}` {t}" for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, last_key, past = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            held = 0
            if carry is not None and tuple(b.column(k)[0].as_py() for k in keys) == last_key:
                held = carry.num_rows
                b = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
            starts = np.flatnonzero(_changes(b, keys))
            first = np.repeat(starts, np.diff([*starts, b.num_rows]))
            # The rows of a continued series count on from those already gone.
            number = np.arange(b.num_rows) - first + 1 + np.where(first == 0, past if held else 0, 0)
            got = function(b, first, number)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(got[c] for c in added)], names=[*kept, *added]).slice(held)
            begin = max(int(starts[-1]), b.num_rows - context)
            carry, last_key, past = b.slice(begin), tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys), int(number[begin]) - 1

    return df.repartition(*keys).sortWithinPartitions(*keys, "ts").mapInArrow(run, schema)
