"""Recursive indicators over bounded frames.

The folds of ``indicators`` say the same in native expressions, at some
microseconds per step; here a step is a numpy operation over all rows of a
block. ``frames`` brings the blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Spec:
    """``kind`` (ema, rsi, atr, adx) with a period over the ``frame`` rows that end ``end`` rows before the current."""

    kind: str
    period: int
    frame: int
    end: int = 0


def _ema(x: np.ndarray, s: np.ndarray, m: np.ndarray, p: int, k: float | None = None) -> np.ndarray:
    """Fold over frames of ``m`` rows from ``s``: seed by the mean of p values, then smooth;
    ``k`` is the EMA's factor, none stands for Wilder's mean."""
    acc, last = np.zeros(len(s)), len(x) - 1
    for t in range(int(m.max(initial=0))):
        v = x[np.minimum(s + t, last)]
        if t < p:
            new = acc + v
            if t == p - 1:
                new /= p
        elif k is None:
            new = (acc * (p - 1) + v) / p
        else:
            new = v * k + acc * (1.0 - k)
        acc = np.where(t < m, new, acc)
    return np.where(m < p, acc / np.maximum(m, 1), acc)


def _adx(tr: np.ndarray, up: np.ndarray, down: np.ndarray, s: np.ndarray, m: np.ndarray, p: int) -> np.ndarray:
    sums = [np.zeros(len(s)) for _ in range(3)]
    v, last = np.zeros(len(s)), len(tr) - 1
    for t in range(int(m.max(initial=0))):
        at, act = np.minimum(s + t, last), t < m
        for k, x in enumerate((tr, up, down)):
            grown = sums[k] + x[at] if t < p else sums[k] - sums[k] / p + x[at]
            sums[k] = np.where(act, grown, sums[k])
        if t >= p - 1:
            st, su, sd = sums
            ok = (st != 0) & (su + sd != 0)
            dx = np.where(np.isnan(st), np.nan, np.where(ok, 100.0 * np.abs(su - sd) / np.where(ok, su + sd, 1.0), 0.0))
            n = t - p + 2
            new = v + dx if n < p else (v + dx) / p if n == p else (v * (p - 1) + dx) / p
            v = np.where(act, new, v)
    few = m - p + 1
    return np.where(few < 1, 0.0, np.where(few < p, v / np.maximum(few, 1), v))


def moves_of(high: np.ndarray, low: np.ndarray, close: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """True range, directional moves and close delta; 0 on a series' first row, NaN beside a NaN."""
    i = np.arange(len(close))
    before, new = np.maximum(i - 1, 0), i == first
    pc, ph, pl = close[before], high[before], low[before]
    tr = np.where(new, 0.0, np.maximum(high - low, np.maximum(np.abs(high - pc), np.abs(low - pc))))
    u, d = high - ph, pl - low
    unknown = np.where(np.isnan(u) | np.isnan(d), np.nan, 0.0)
    up, down = np.where(~new & (u > d) & (u > 0), u, unknown), np.where(~new & (d > u) & (d > 0), d, unknown)
    return tr, np.where(new, 0.0, up), np.where(new, 0.0, down), np.where(new, 0.0, close - pc)


def kernel(high: np.ndarray, low: np.ndarray, close: np.ndarray, first: np.ndarray, specs: dict[str, Spec]) -> dict[str, np.ndarray]:
    """Values for every row; ``first`` is the index of the first row at hand of each row's series."""
    i = np.arange(len(close))
    tr, up, down, delta = moves_of(high, low, close, first)
    out = {}
    for name, spec in specs.items():
        m = np.clip(np.minimum(i + spec.end - first + 1, spec.frame), 0, None)
        s = i + spec.end - m + 1
        p = spec.period
        if spec.kind == "ema":
            out[name] = _ema(close, s, m, p, 2.0 / (p + 1))
            continue
        s, m = s + 1, np.maximum(m - 1, 0)  # moves of a frame's first row look outside it
        if spec.kind == "atr":
            out[name] = _ema(tr, s, m, p)
        elif spec.kind == "adx":
            out[name] = _adx(tr, up, down, s, m, p)
        else:
            g, lo = _ema(np.maximum(delta, 0.0), s, m, p), _ema(np.maximum(-delta, 0.0), s, m, p)
            out[name] = np.where(m < p, 50.0, np.where(lo == 0, 100.0, 100.0 - 100.0 / (1.0 + g / np.where(lo == 0, 1.0, lo))))
    return out
