"""Position simulation: exits are data-parallel, only occupancy is a fold.

A trade's exit depends on its entry row and the next few rows, so every
candidate gets its exit from a forward frame. One position at a time and the
daily loss limit are decided by a fold over candidates, cut into segments at
points where nothing can be open and a new day has begun. Segments stream
through sorted, so the fold's memory is one batch whatever a segment's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.candle import SLIPPAGE, TAKER_FEE, liquidation_price, midnight
from wickflow.operators import risk
from wickflow.operators.frames import fields
from wickflow.operators.indicators import keys, ordered
from wickflow.operators.prefix import CHUNK_ROWS, cut, numbered, running, whole
from wickflow.operators.signals import evaluate
from wickflow.params import Params
from wickflow.scratch import materialise, ship

#: Rows at a series' start that are not traded.
WARM_UP = 60
#: Money in a bucket before a trade.
BUCKET = 10.0


def fold_split(df: DataFrame, train: float = 0.6, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``fold``: in_sample for the first part of each series, else out_sample. Frames of the whole series go."""
    df = df.drop(*[c for c in fields(Params(), None, True) if c in df.columns])
    k, df = keys(df), materialise(df, "split")
    df = whole(numbered(cut(df, k, "ts", rows), k, ["ts"], "__rn"))
    # Counts per series are pre-aggregated, and joined instead of windowed.
    df = df.join(df.groupBy(*k).agg(F.count(F.lit(1)).alias("__n")), k)
    return df.withColumn("fold", F.when(F.col("__rn") <= F.floor(F.lit(float(train)) * F.col("__n")), "in_sample").otherwise("out_sample")).drop("__rn", "__n")


def entries(evaluated: DataFrame, leverage: int) -> DataFrame:
    """Add fill, notional, entry fee, liquidation price and the row-local risk reason to fired rows."""
    long = F.col("side") == "long"
    fill = F.col("entry_price") * F.when(long, 1.0 + SLIPPAGE).otherwise(1.0 - SLIPPAGE)
    df = evaluated.withColumns({"fill": fill, "notional": F.col("size_usdt") * leverage,
                                "risk_reason": F.when(F.col("outcome") == "fired", risk.row_reason(F.col("entry_price"), F.col("tp_price"), F.col("sl_price"), F.col("side"), leverage))})
    return df.withColumns({"fee_entry": F.col("notional") * TAKER_FEE, "liquidation_price": liquidation_price(F.col("fill"), F.col("side"), leverage)})


def hit(direction: Column, high: Column, low: Column, tp: Column, sl: Column, liq: Column) -> Column:
    """Close reason of a bar for a position, take-profit first; null: none."""
    up = F.when(high >= tp, "take_profit").when(low <= sl, "stop_loss").when(low <= liq, "liquidated")
    down = F.when(low <= tp, "take_profit").when(high >= sl, "stop_loss").when(high >= liq, "liquidated")
    return F.when(direction == "long", up).otherwise(down)


def exits(df: DataFrame, params: Params = Params(), exit_mode: str = "intrabar") -> DataFrame:
    """Add exit_rn, exit_ts, close_reason, raw exit price and ``forced`` to every row from its forward frame."""
    w = ordered(df)
    high, low = ("high", "low") if exit_mode == "intrabar" else ("close", "close")
    ahead = F.collect_list(F.struct("rn", "ts", F.col(high).alias("h"), F.col(low).alias("l"), "close")).over(w.rowsBetween(1, params.largest("max_hold_candles")))
    df = df.withColumn("ahead", F.slice(ahead, 1, F.lit(params.max_hold_candles)))
    bar = lambda b: hit(F.col("side"), b["h"], b["l"], F.col("tp_price"), F.col("sl_price"), F.col("liquidation_price"))
    met = F.filter(F.transform("ahead", lambda b: F.struct(b["rn"].alias("rn"), b["ts"].alias("ts"), b["close"].alias("close"), bar(b).alias("why"))), lambda b: b["why"].isNotNull())
    last = F.when(F.size("ahead") > 0, F.element_at("ahead", -1))
    df = df.withColumn("first", F.when(F.size(met) > 0, F.get(met, 0))).withColumn("last", last)
    timeout = F.size("ahead") >= F.lit(params.max_hold_candles)
    why = F.coalesce(F.col("first.why"), F.lit("timeout"))
    raw = F.when(why == "take_profit", F.col("tp_price")).when(why == "stop_loss", F.col("sl_price")).when(why == "liquidated", F.col("liquidation_price")).otherwise(
        F.coalesce(F.col("last.close"), F.col("close")))
    return df.withColumns({
        "forced": F.col("first").isNull() & ~timeout, "exit_rn": F.coalesce(F.col("first.rn"), F.col("last.rn"), F.col("rn")),
        "exit_ts": F.coalesce(F.col("first.ts"), F.col("last.ts"), F.col("ts")), "close_reason": why, "raw_exit": raw}).drop("ahead", "first", "last")


def closes(df: DataFrame) -> DataFrame:
    """Add the close result: exit price with slippage, fees, pnl and holding time."""
    long = F.col("side") == "long"
    price = F.col("raw_exit") * F.when(long, 1.0 - SLIPPAGE).otherwise(1.0 + SLIPPAGE)
    gross = F.when(long, price - F.col("fill")).otherwise(F.col("fill") - price) / F.col("fill") * F.col("notional")
    fee = F.col("notional") * TAKER_FEE
    net = gross - (F.col("fee_entry") + fee)
    # A fixed quirk: any timeframe whose name holds "5m" counts in five minutes, "15m" too.
    step = F.when(F.col("timeframe").contains("5m"), 300_000).otherwise(900_000)
    return df.withColumns({
        "exit_price": F.round(price, 8), "pnl_gross_usdt": F.round(gross, 6), "fee_exit_usdt": F.round(fee, 6), "pnl_net_usdt": F.round(net, 6),
        "pnl_pct": F.round(net / F.col("size_usdt") * 100.0, 4), "bucket_balance_after": F.round(BUCKET + net, 4),
        "hold_candles": F.greatest(F.floor((F.col("exit_ts") - F.col("ts")) / step), F.lit(1)).cast("int")})


def _walk(names: list[str]):
    """Rows sorted by ``names`` and rn; the open position and the day's result are carried over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, free, day, pnl = None, -1, -1, 0.0
        for b in batches:
            accepted, sums = [], []
            rows = zip(zip(*(b.column(k).to_pylist() for k in names)), *(b.column(c).to_pylist() for c in ("rn", "free_rn", "day", "exit_day", "pnl_net_usdt")))
            for key, rn, free_rn, today, exit_day, net in rows:
                if key != segment:
                    segment, free, day, pnl = key, -1, -1, 0.0
                if rn < free:
                    accepted.append(None)
                    sums.append(None)
                    continue
                so_far = pnl if day == today else 0.0
                accepted.append(so_far > risk.DAILY_LOSS)
                sums.append(so_far)
                if accepted[-1]:
                    pnl = (pnl if day == exit_day else 0.0) + (net or 0.0)
                    free, day = free_rn, exit_day
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names[:-1]), b.column("rn"), pa.array(accepted, pa.bool_()), pa.array(sums, pa.float64())],
                                             names=[*names[:-1], "rn", "accepted", "day_pnl"])

    return run


def _occupancy(cands: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys, rn, ``accepted`` and ``day_pnl`` of candidates (rn, free_rn, day, exit_day, pnl_net_usdt).

    Both are null while a position is open; a trade without a result books
    nothing. Segments are independent; one of any length streams through.
    """
    ship(cands.sparkSession)
    k = keys(cands)
    cands = running(cut(cands, k, "day", rows), k, ["rn"], {"busy_rn": ("max", F.col("free_rn")), "busy_day": ("max", F.col("exit_day"))}, exclusive=True)
    anew = (F.col("busy_rn") <= F.col("rn")) & (F.col("busy_day") < F.col("day"))
    cands = whole(running(cands.withColumn("cut", F.coalesce(anew, F.lit(True)).cast("int")), k, ["rn"], {"segment": ("sum", F.col("cut"))}))
    cands = cands.select(*k, "segment", "rn", "free_rn", "day", "exit_day", "pnl_net_usdt")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in cands.dtypes if c in k), "rn int", "accepted boolean", "day_pnl double"])
    return cands.repartition(*k, "segment").sortWithinPartitions(*k, "segment", "rn").mapInArrow(_walk([*k, "segment"]), schema)


def simulate(evaluated: DataFrame, params: Params = Params(), leverage: int = 20, warm_up: int = WARM_UP, exit_mode: str = "intrabar", reentry_same_candle: bool = True,
             rows: int = CHUNK_ROWS) -> DataFrame:
    """Evaluated candles after the warm-up with the fate of each: exits, accepted, held.

    ``accepted`` is true for trades, false where the daily loss limit stopped
    one; ``held`` marks candles on which a position was open and nothing was
    evaluated.
    """
    df = closes(exits(entries(evaluated, leverage), params, exit_mode))
    end = F.max("rn").over(Window.partitionBy(*keys(df)))
    free = F.when(F.col("forced"), end + 1).otherwise(F.col("exit_rn") + (0 if reentry_same_candle else 1))
    df = df.withColumns({"free_rn": free.cast("int"), "day": midnight(F.col("ts")), "exit_day": midnight(F.col("exit_ts"))}).filter(F.col("rn") > warm_up)
    # Candidates and candles are read from one table: the pipeline above runs once.
    df = materialise(df, "simulation")
    able = (F.col("outcome") == "fired") & F.col("risk_reason").isNull() & (F.lit(params.max_active_buckets) > 0)
    k = keys(df)
    df = df.join(_occupancy(df.filter(able), rows), [*k, "rn"], "left")
    df = whole(running(cut(df, k, "ts", rows), k, ["rn"], {"busy": ("max", F.when(F.col("accepted"), F.col("free_rn")))}, exclusive=True))
    return df.withColumn("held", F.coalesce(F.col("busy") > F.col("rn"), F.lit(False))).drop("busy")


def trades(simulated: DataFrame) -> DataFrame:
    """One row per closed trade."""
    cols = [*keys(simulated), F.col("side").alias("direction"), "pattern", "confidence", F.col("ts").alias("entry_ts"), F.col("fill").alias("entry_price"), "tp_price", "sl_price",
            "liquidation_price", "size_usdt", F.col("notional").alias("notional_usdt"), F.col("fee_entry").alias("fee_entry_usdt"), "exit_ts", "exit_price", "hold_candles",
            "pnl_gross_usdt", "fee_exit_usdt", "pnl_net_usdt", "pnl_pct", "bucket_balance_after", "close_reason", "forced"]
    return simulated.filter("accepted").select(*cols)


def signal_log(simulated: DataFrame, max_active_buckets: int = 1) -> DataFrame:
    """One row per evaluated candle: fired, or rejected with stage and reason."""
    df = simulated.filter(~F.col("held"))
    risk_reason = F.when(F.col("outcome") == "fired", F.when(F.lit(max_active_buckets <= 0), "bucket_limit").otherwise(
        F.coalesce(F.col("risk_reason"), F.when(~F.coalesce(F.col("accepted"), F.lit(False)), "daily_loss_limit"))))
    return df.select(*keys(df), "ts", F.when(risk_reason.isNotNull(), "rejected").otherwise(F.col("outcome")).alias("outcome"),
                     F.when(risk_reason.isNotNull(), "risk").otherwise(F.col("stage")).alias("stage"), F.coalesce(risk_reason, F.col("reason")).alias("reason"),
                     F.when(risk_reason.isNull(), F.col("pattern")).alias("pattern"), F.when(risk_reason.isNull(), F.col("side")).alias("direction"), F.when(risk_reason.isNull(), F.col("confidence")).alias("confidence"))


def equity_curve(simulated: DataFrame, ref_compatible: bool = False, rows: int = CHUNK_ROWS) -> DataFrame:
    """Equity after each candle from trades closed up to it; forced closes come after the last.

    With ``ref_compatible`` a candle that closes a trade has two points.
    """
    k = keys(simulated)
    booked = simulated.filter(F.col("accepted") & ~F.col("forced")).groupBy(*k, F.col("exit_rn").alias("rn")).agg(F.sum("pnl_net_usdt").alias("booked"))
    points = simulated.select(*k, "rn", "ts").join(booked, [*k, "rn"], "left")
    points = whole(running(cut(points, k, "ts", rows), k, ["rn"], {"equity": ("sum", F.coalesce("booked", F.lit(0.0)))}))
    if ref_compatible:
        points = points.withColumn("point", F.explode(F.sequence(F.lit(1), F.when(F.col("booked").isNotNull(), 2).otherwise(1))))
    return points.drop("booked")


def backtest(enriched: DataFrame, params: Params = Params(), **options) -> DataFrame:
    return simulate(evaluate(enriched, params), params, **options)


def walk_forward(enriched: DataFrame, params: Params = Params(), train: float = 0.6, **options) -> DataFrame:
    """The backtest on either side of a split; frames don't cross it, stored indicators do."""
    return backtest(fold_split(enriched, train), params, **options)
