"""Pattern memory: keyed results of closed trades and their feedback on confidence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.operators.prefix import by_day, running
from wickflow.scratch import ship

KEY = ("pattern", "direction", "session", "regime")


def stats(trades: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Count, wins, win rate and mean pnl per key, from plain sums. The step-wise
    rounded running mean is ``stepwise``; the two differ in the fourth decimal."""
    wins = F.sum(F.when(F.col("pnl_net_usdt") > 0, 1).otherwise(0))
    return trades.groupBy(*key).agg(F.count(F.lit(1)).alias("sample_count"), wins.cast("long").alias("win_count"), F.avg("pnl_pct").alias("avg_pnl_pct"), F.max("exit_ts").alias("last_updated")).withColumn(
        "win_rate", F.round(F.col("win_count") / F.col("sample_count"), 4)).withColumn("avg_pnl_pct", F.round("avg_pnl_pct", 4))


def _rounding(names: list[str]):
    """Rows sorted by ``names`` and exit time; the key's count, wins and mean are carried over batches, so any number of trades streams through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, wins, mean, last = None, 0, 0, 0.0, None

        def done() -> pa.RecordBatch:
            cols = [pa.array([k], b.schema.field(c).type) for k, c in zip(key, names)] + [pa.array([x], t) for x, t in ((n, pa.int64()), (wins, pa.int64()), (mean, pa.float64()), (last, pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=[*names, "sample_count", "win_count", "avg_pnl_pct", "last_updated"])

        for b in batches:
            for *mine, at, net, pct in zip(*(b.column(c).to_pylist() for c in (*names, "exit_ts", "pnl_net_usdt", "pnl_pct"))):
                if mine != key:
                    if key is not None:
                        yield done()
                    key, n, wins, mean, last = mine, 0, 0, 0.0, None
                n, wins, last = n + 1, wins + (net is not None and net > 0), at
                mean = round((mean * (n - 1) + (pct or 0.0)) / n, 4)
        if key is not None:
            yield done()

    return run


def stepwise(trades: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Memory as it grows trade by trade in order of exit: the mean is rounded to four decimals after every trade.

    The rounding makes it sequential within a key; a key's trades stream through
    one task sorted, in bounded memory. Trades of equal exit time follow by their
    pnl; a null pnl counts as 0.
    """
    ship(trades.sparkSession)
    rows = trades.select(*key, F.col("exit_ts").cast("long").alias("exit_ts"), F.col("pnl_net_usdt").cast("double").alias("pnl_net_usdt"), F.col("pnl_pct").cast("double").alias("pnl_pct"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c in key), "sample_count long, win_count long, avg_pnl_pct double, last_updated long"])
    found = rows.repartition(*key).sortWithinPartitions(*key, "exit_ts", "pnl_pct", "pnl_net_usdt").mapInArrow(_rounding(list(key)), schema)
    return found.withColumn("win_rate", F.round(F.col("win_count") / F.col("sample_count"), 4))


def at_time(rows: DataFrame, trades: DataFrame, key: tuple[str, ...] = ("pattern", "direction"), ts: str = "ts") -> DataFrame:
    """``rows`` with sample_count, win_count and win_rate of their key's trades that closed before ``ts``.

    Rows and closings meet in one union and one running sum per key, cut by days,
    since a key of small domains holds any share of all trades. A trade that
    closes at a row's very time comes after it; open trades count never.
    """
    asked = rows.select(*key, F.col(ts).alias("__at"), F.lit(0).alias("__trade"), F.lit(0).alias("__win"), F.struct(*[F.col(c) for c in rows.columns]).alias("__row"))
    closed = trades.filter(F.col("exit_ts").isNotNull()).select(*key, F.col("exit_ts").alias("__at"), F.lit(1).alias("__trade"), F.when(F.col("pnl_net_usdt") > 0, 1).otherwise(0).alias("__win"),
                                                                F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"))
    both = by_day(asked.unionByName(closed), "__at")
    run = running(both, list(key), ["__at", "__trade"], {"sample_count": ("sum", F.col("__trade")), "win_count": ("sum", F.col("__win"))})
    return run.filter(F.col("__row").isNotNull()).select("__row.*", "sample_count", "win_count", F.round(F.col("win_count") / F.nullif(F.col("sample_count"), F.lit(0)), 4).alias("win_rate"))


def total(rows: DataFrame) -> DataFrame:
    """Memory rows of any number of sources: counts added and rates recomputed."""
    mean = F.sum(F.col("avg_pnl_pct") * F.col("sample_count")) / F.sum("sample_count")
    return rows.groupBy(*KEY).agg(F.sum("sample_count").alias("sample_count"), F.sum("win_count").alias("win_count"), F.round(mean, 4).alias("avg_pnl_pct"), F.max("last_updated").alias("last_updated")).withColumn(
        "win_rate", F.round(F.col("win_count") / F.col("sample_count"), 4))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: memory rows of both."""
    names = (*KEY, "sample_count", "win_count", "avg_pnl_pct", "last_updated")
    return total(old.select(*names).unionByName(new.select(*names)))


def adjust(raw: Column, samples: Column, win_rate: Column, min_samples: int = 10) -> Column:
    blended = F.round(F.greatest(F.lit(0.30), F.least(F.lit(0.95), raw * 0.70 + win_rate * 0.30)), 3)
    return F.when((F.coalesce(samples, F.lit(0)) >= min_samples) & win_rate.isNotNull(), blended).otherwise(raw)


def suppressed(samples: Column, win_rate: Column, min_samples: int = 20, min_win_rate: float = 0.35) -> Column:
    return F.coalesce((samples >= min_samples) & (win_rate < min_win_rate), F.lit(False))


def lookup(df: DataFrame, memory: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Left join on the memory key; the table has one row per key of four small domains."""
    return df.join(F.broadcast(memory.select(*key, "sample_count", "win_rate")), list(key), "left")
