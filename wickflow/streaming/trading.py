"""From closed candles to trades in one streaming query.

Two keyed operators follow one another. The first holds the last rows of each
series and adds every frame-dependent column to new candles, by the functions of
the batch pass; no batch reads a store. What follows it is the batch's own
projections: gates, detectors, signal, entry prices. The second holds the open
position and the day's result of each series and yields tagged rows: candles,
log entries, opened positions, closed trades. A batch is committed by one write
that splits the rows by their tag into a folder of its own, so a batch that
runs twice after a failure leaves one copy. State lives in RocksDB under the
query's checkpoint; a restart goes on where it stopped.

Differences from a batch run: a position that is still open has no forced
close; a candle at or before the newest known of its series is dropped, whether
it came late or twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wickflow.functions.candle import SLIPPAGE, TAKER_FEE, geometry
from wickflow.operators import backtest, risk
from wickflow.operators.frames import FRAME, STORED, compute, fields
from wickflow.operators.signals import judge
from wickflow.params import Params
from wickflow.schemas import DAY_MS, SERIES
from wickflow.scratch import ship, ship_to_driver
from wickflow.sources.candles import recent

#: Rows of history that make every frame of a new row complete: the evaluation
#: window, a stored-indicator frame for its oldest row, and the lags.
HISTORY = 2 * FRAME + 20
#: What the ring holds of a candle; ``number`` counts the rows of its series.
RING = ("ts bigint, open double, high double, low double, close double, volume double, body_size double, total_range double, body_ratio double, upper_wick double, "
        "lower_wick double, direction string, number bigint")
_KEPT = [c.split()[0] for c in RING.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state with lists needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _arrow_types(names: dict[str, str]) -> dict[str, pa.DataType]:
    return {c: {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}.get(t, pa.float64()) for c, t in names.items()}


class Ring(StatefulProcessor):
    """The newest rows of a series, and the frame columns of the candles that join them."""

    def __init__(self, params: Params, buffer: int = FRAME, window: int = FRAME, passing: tuple[str, ...] = ()) -> None:
        self.params, self.buffer, self.window, self.passing = params, buffer, window, passing
        self.types = _arrow_types(dict(x.split() for x in RING.split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", RING)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Rows of a store, each with its number; they may come in several frames."""
        self.rows.appendList([tuple(r) for r in initialState.sort_values("ts")[_KEPT].itertuples(index=False)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = sorted(self.rows.get()) if self.rows.exists() else []
        new = pd.concat(list(rows)).sort_values("ts", kind="stable").drop_duplicates("ts")
        if held:
            new = new[new["ts"] > held[-1][0]]
        if new.empty:
            return
        new = new.reset_index(drop=True)
        new["number"] = range((held[-1][-1] if held else 0) + 1, (held[-1][-1] if held else 0) + 1 + len(new))
        context = held[-HISTORY:]
        old = dict(zip(_KEPT, zip(*context))) if context else {c: () for c in _KEPT}
        block = pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(old[c], t, from_pandas=True), pa.array(new[c].tolist(), t, from_pandas=True)]) for c, t in self.types.items()], names=_KEPT)
        first = block.column("ts").to_numpy() * 0
        number = block.column("number").to_numpy()
        got = compute(block, first, number, self.params, self.buffer, self.window, STORED)
        out = {c: [v] * len(new) for c, v in zip(SERIES, key)} | {c: new[c].tolist() for c in (*_KEPT[:-1], *self.passing)}
        yield pd.DataFrame(out | {c: v.slice(len(context)).to_pylist() for c, v in got.items()}, dtype=object)
        added = [tuple(r) for r in new[_KEPT].itertuples(index=False)]
        # The list grows to twice the history and is then cut, so most batches only append.
        if len(held) + len(added) <= 2 * HISTORY:
            self.rows.appendList(added)
        else:
            self.rows.put([*held, *added][-HISTORY:])

    def close(self) -> None:
        pass


def bootstrap(stored: DataFrame) -> DataFrame:
    """The newest stored candles of each series as first state: numbered, with geometry."""
    counts = stored.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("c"))
    back = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("ts")))
    rows = recent(stored, HISTORY).withColumn("back", back).join(counts, list(SERIES))
    return geometry(rows.withColumn("number", F.col("c") - F.col("back") + 1)).select(*SERIES, *_KEPT)


def with_frames(candles: DataFrame, params: Params = Params(), stored: DataFrame | None = None, buffer: int = FRAME, window: int = FRAME, passing: tuple[str, ...] = ()) -> DataFrame:
    """Streamed candles with all frame columns, from keyed state alone; ``stored`` fills it before the first batch."""
    spark = candles.sparkSession
    ship(spark)
    ship_to_driver(spark)
    use_rocksdb(spark)
    types = dict(candles.dtypes)
    made = fields(params, STORED, True)
    schema = ", ".join([*(f"{c} string" for c in SERIES), *RING.split(", ")[:-1], *(f"{c} {types[c]}" for c in passing), *(f"`{c}` {t}" for c, t in made.items())])
    start = None if stored is None else bootstrap(stored).groupBy(*SERIES)
    return geometry(candles).groupBy(*SERIES).transformWithStateInPandas(Ring(params, buffer, window, passing), schema, "append", "None", start)


def signals(candles: DataFrame, params: Params = Params(), stored: DataFrame | None = None) -> DataFrame:
    """A fired signal or the first rejection of each streamed candle."""
    return judge(with_frames(candles, params, stored), params)


#: What the position's operator reads and yields beside the series.
_READ = ("rn", "ts", "open", "high", "low", "close", "volume", "regime", "outcome", "stage", "reason", "pattern", "side", "confidence", "entry_price", "tp_price", "sl_price", "size_usdt",
         "fill", "notional", "fee_entry", "liquidation_price", "risk_reason", "stale")
_POSITION = ("side string, pattern string, confidence double, ts bigint, fill double, tp_price double, sl_price double, liquidation_price double, size_usdt double, notional double, "
             "fee_entry double, held bigint")
_TAGGED = ("bot_id string, pair string, timeframe string, kind string, ts bigint, open double, high double, low double, close double, volume double, regime string, outcome string, stage string, "
           "reason string, pattern string, side string, confidence double, fill double, tp_price double, sl_price double, liquidation_price double, size_usdt double, notional double, fee_entry double, "
           "exit_ts bigint, close_reason string, raw_exit double")
_HELD = [c.split()[0] for c in _POSITION.split(", ")]
_OUT = [c.split()[0] for c in _TAGGED.split(", ")]


def _none(value):
    return None if value is None or value != value else value


def exit_of(position: dict, high: float, low: float, max_hold: int) -> str | None:
    """Why a bar closes a position, take-profit first; None: it stays open."""
    sign = 1 if position["side"] == "long" else -1
    best, worst = (high, low) if sign == 1 else (-low, -high)
    if best >= sign * position["tp_price"]:
        return "take_profit"
    if worst <= sign * position["sl_price"]:
        return "stop_loss"
    if worst <= sign * position["liquidation_price"]:
        return "liquidated"
    return "timeout" if position["held"] >= max_hold else None


def net_of(position: dict, raw: float) -> float:
    """What a close at ``raw`` brings after fees, as the batch's columns say it."""
    sign = 1 if position["side"] == "long" else -1
    price = raw * (1.0 - sign * SLIPPAGE)
    gross = sign * (price - position["fill"]) / position["fill"] * position["notional"]
    return round(gross - (position["fee_entry"] + position["notional"] * TAKER_FEE), 6)


class Positions(StatefulProcessor):
    """One open position and the day's result of each series."""

    def __init__(self, params: Params, warm_up: int, exit_mode: str, reentry_same_candle: bool) -> None:
        self.params, self.warm_up, self.exit_mode, self.reentry = params, warm_up, exit_mode, reentry_same_candle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", _POSITION)
        self.day = handle.getValueState("day", "day bigint, pnl double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(_HELD, self.position.get())) if self.position.exists() else None
        day, pnl = self.day.get() if self.day.exists() else (-1, 0.0)
        out: list[dict] = []
        tag = lambda kind, **fields: out.append(dict(zip(SERIES, key)) | {"kind": kind} | fields)
        for r in pd.concat(list(rows)).sort_values("ts")[list(_READ)].itertuples(index=False):
            tag("candle", ts=r.ts, open=r.open, high=r.high, low=r.low, close=r.close, volume=r.volume, regime=_none(r.regime))
            if r.rn <= self.warm_up:
                continue
            if r.ts // DAY_MS > day:
                day, pnl = r.ts // DAY_MS, 0.0
            if held:
                held["held"] += 1
                high, low = (r.high, r.low) if self.exit_mode == "intrabar" else (r.close, r.close)
                why = exit_of(held, high, low, self.params.max_hold_candles)
                if why is None:
                    continue
                raw = {"take_profit": held["tp_price"], "stop_loss": held["sl_price"], "liquidated": held["liquidation_price"]}.get(why, r.close)
                pnl += net_of(held, raw)
                tag("trade", **{c: v for c, v in held.items() if c != "held"}, exit_ts=r.ts, close_reason=why, raw_exit=raw)
                held = None
                if not self.reentry:
                    continue
            entry = self._entry(r, pnl)
            if r.outcome != "fired" or isinstance(entry, str):
                risky = r.outcome == "fired"
                tag("log", ts=r.ts, outcome="rejected", stage="risk" if risky else _none(r.stage), reason=entry if risky else _none(r.reason))
                continue
            held = entry
            tag("log", ts=r.ts, outcome="fired", pattern=r.pattern, side=r.side, confidence=r.confidence)
            tag("position", **{c: v for c, v in held.items() if c != "held"})
        self.day.update((int(day), float(pnl)))
        if held:
            self.position.update(tuple(held[c] for c in _HELD))
        else:
            self.position.clear()
        yield pd.DataFrame(out, columns=_OUT, dtype=object)

    def _entry(self, r, pnl: float) -> dict | str:
        """The position that a fired row opens, or why it must not."""
        if self.params.max_active_buckets <= 0:
            return "bucket_limit"
        if _none(r.risk_reason):
            return r.risk_reason
        if pnl <= risk.DAILY_LOSS:
            return "daily_loss_limit"
        if r.stale:
            return "stale_data"
        return {c: getattr(r, c) for c in _HELD if c != "held"} | {"held": 0}

    def close(self) -> None:
        pass


def trading(candles: DataFrame, params: Params = Params(), stored: DataFrame | None = None, leverage: int = 20, warm_up: int = backtest.WARM_UP, exit_mode: str = "intrabar",
            reentry_same_candle: bool = True) -> DataFrame:
    """Tagged rows of streamed candles: ``kind`` is candle, log, position or trade.

    ``since_reconnect_ms`` may come with the candles; younger than a minute, the
    feed's data opens nothing.
    """
    guarded = "since_reconnect_ms" in candles.columns
    judged = backtest.entries(judge(with_frames(candles, params, stored, passing=("since_reconnect_ms",) if guarded else ()), params), leverage)
    stale = F.coalesce(F.col("since_reconnect_ms") < risk.STALE_SECONDS * 1000, F.lit(False)) if guarded else F.lit(False)
    return positions(judged.withColumn("stale", stale), params, warm_up, exit_mode, reentry_same_candle)


def positions(entries: DataFrame, params: Params, warm_up: int, exit_mode: str = "intrabar", reentry_same_candle: bool = True) -> DataFrame:
    """Tagged rows of judged candles with their entry columns, closed trades with all their results."""
    use_rocksdb(entries.sparkSession)
    ship(entries.sparkSession)
    ship_to_driver(entries.sparkSession)
    step = Positions(params, warm_up, exit_mode, reentry_same_candle)
    return backtest.closes(entries.select(*SERIES, *_READ).groupBy(*SERIES).transformWithStateInPandas(step, _TAGGED, "append", "None"))


def position_updates(candles: DataFrame, leverage: int = 20, params: Params = Params()) -> DataFrame:
    """Opened and closed positions of candles that were judged elsewhere.

    Input: series, ts, high, low, close, outcome, side, entry_price, tp_price,
    sl_price, size_usdt, and optionally ``since_reconnect_ms``; output: one row
    per opened or closed position.
    """
    missing = {c: F.lit(None).cast("string" if c in ("regime", "stage", "reason", "pattern") else "double") for c in ("open", "volume", "regime", "stage", "reason", "pattern", "confidence") if c not in candles.columns}
    stale = F.coalesce(F.col("since_reconnect_ms") < risk.STALE_SECONDS * 1000, F.lit(False)) if "since_reconnect_ms" in candles.columns else F.lit(False)
    judged = backtest.entries(candles.withColumns(missing | {"rn": F.lit(1), "stale": stale}), leverage)
    rows = positions(judged, params, 0).filter("kind in ('position', 'trade')")
    opened = F.col("kind") == "position"
    return rows.select(*SERIES, F.when(opened, F.col("ts")).otherwise(F.col("exit_ts")).alias("ts"), F.when(opened, "open").otherwise("close").alias("event"), "side",
                       F.round(F.when(opened, F.col("fill")).otherwise(F.col("exit_price")), 8).alias("price"), F.col("close_reason").alias("reason"), "pnl_net_usdt")


def commit(root: str):
    """The sink of a batch: one write that parts rows by kind, into a folder that a repeat replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{root.rstrip('/')}/batch={batch_id}")

    return write


def start(tagged: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Run what there is and stop; a later start with the same checkpoint goes on."""
    return tagged.writeStream.foreachBatch(commit(root)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def committed(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """What the batches have written of one kind."""
    schema = f"{_TAGGED}, exit_price double, pnl_gross_usdt double, fee_exit_usdt double, pnl_net_usdt double, pnl_pct double, bucket_balance_after double, hold_candles int, batch bigint"
    return spark.read.schema(schema).option("basePath", root).parquet(root).filter(F.col("kind") == kind)


def trades(spark: SparkSession, root: str) -> DataFrame:
    """Closed trades in the batch run's columns."""
    return committed(spark, root, "trade").select(
        *SERIES, F.col("side").alias("direction"), "pattern", "confidence", F.col("ts").alias("entry_ts"), F.col("fill").alias("entry_price"), "tp_price", "sl_price", "liquidation_price", "size_usdt",
        F.col("notional").alias("notional_usdt"), F.col("fee_entry").alias("fee_entry_usdt"), "exit_ts", "exit_price", "hold_candles", "pnl_gross_usdt", "fee_exit_usdt", "pnl_net_usdt", "pnl_pct",
        "bucket_balance_after", "close_reason")


def signal_log(spark: SparkSession, root: str) -> DataFrame:
    return committed(spark, root, "log").select(*SERIES, "ts", "outcome", "stage", "reason", "pattern", F.col("side").alias("direction"), "confidence")
