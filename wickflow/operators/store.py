"""Operations on the store: upserts, closes, retention, context, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.candle import midnight
from wickflow.schemas import DAY_MS, HOUR_MS, SERIES


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last write per key, by a pre-aggregated maximum instead of a sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("x")).select(*key, "x.*")


def env_of(bot_id: Column) -> Column:
    return F.when(bot_id.startswith("dev"), "dev").otherwise("prod")


def upsert_candles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Candles of both with last write wins; ``env`` stays what it was at first."""
    key = [*SERIES, "ts"]
    both = stored.withColumn("version", F.lit(0)).unionByName(incoming.withColumn("env", env_of(F.col("bot_id"))).withColumn("version", F.lit(1)))
    rest = [c for c in both.columns if c not in (*key, "version", "env")]
    out = both.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("x"), F.min_by("env", "version").alias("env"))
    return out.select(*key, "x.*", "env")


def close_trades(opened: DataFrame, closings: DataFrame) -> DataFrame:
    """Opened trades with the columns of their closing rows, where there are any."""
    update = [c for c in closings.columns if c != "trade_id"]
    met = opened.join(closings.select("trade_id", F.struct(*update).alias("z")), "trade_id", "left")
    return met.withColumns({c: F.coalesce(F.col("z")[c], F.col(c)) if c in opened.columns else F.col("z")[c] for c in update}).drop("z")


def expired_candles(candles: DataFrame, context: DataFrame, now: int, days: int = 90) -> DataFrame:
    """Candles past retention that no trade context refers to."""
    old = candles.filter(F.col("ts") < now - days * DAY_MS)
    return old.join(context.select("candle_id").distinct(), "candle_id", "left_anti")


def retained(df: DataFrame, now: int, days: int) -> DataFrame:
    return df.filter(F.col("ts") >= now - days * DAY_MS)


def trade_context(trades: DataFrame, candles: DataFrame, hours: int = 48) -> DataFrame:
    """Candles within ``hours`` before entry and after exit of each trade, with their offset in hours and in candles.

    In candles: 0 is the first one at or after the anchor, -1 the last before it,
    missing candles don't count. A window holds every candle of its span, so the
    offset is the rank counted away from the anchor: one window of bounded size,
    positions in the series aren't needed. Repeated rows share a rank.

    A range join made of equi-joins: each window is cut into days, and pair and
    day are the join key, so hot pairs spread over their days.
    """
    span = hours * HOUR_MS
    ends = trades.select("trade_id", "pair", "entry_ts", F.coalesce("exit_ts", "entry_ts").alias("exit_ts"))
    windows = ends.select("trade_id", "pair", F.lit("pre").alias("window"), F.col("entry_ts").alias("anchor"), (F.col("entry_ts") - span).alias("lo"), (F.col("entry_ts") - 1).alias("hi")).unionByName(
        ends.select("trade_id", "pair", F.lit("post").alias("window"), F.col("exit_ts").alias("anchor"), F.col("exit_ts").alias("lo"), (F.col("exit_ts") + span).alias("hi")))
    day = lambda c: F.floor(F.col(c) / DAY_MS)
    windows = windows.withColumn("day", F.explode(F.sequence(day("lo"), day("hi"))))
    bars = candles.select("pair", F.col("ts").alias("candle_ts"), F.floor(F.col("ts") / DAY_MS).alias("day"))
    met = windows.join(bars, ["pair", "day"]).filter(F.col("candle_ts").between(F.col("lo"), F.col("hi")))
    pre = F.col("window") == "pre"
    away = F.dense_rank().over(Window.partitionBy("trade_id", "pair", "window", "anchor").orderBy(F.when(pre, -F.col("candle_ts")).otherwise(F.col("candle_ts"))))
    return met.select("trade_id", "window", "candle_ts", ((F.col("candle_ts") - F.col("anchor")) / HOUR_MS).alias("offset_hours"), F.when(pre, -away).otherwise(away - 1).alias("offset_candles"))


def link_context(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored context rows and those new ones whose (trade_id, candle_ts) is not there yet; of equal new ones one."""
    key = ["trade_id", "candle_ts"]
    return stored.unionByName(new.dropDuplicates(key).join(stored.select(*key), key, "left_anti"))


def mark_post_complete(trades: DataFrame, now: int, hours: int = 48) -> DataFrame:
    """Add ``context_post_complete``: the window after the exit has passed."""
    return trades.withColumn("context_post_complete", F.coalesce(F.col("exit_ts") + hours * HOUR_MS <= now, F.lit(False)))


def with_trades(rows: DataFrame, trades: DataFrame, *columns: str) -> DataFrame:
    """Signals or events with columns of the trade they refer to; null without one."""
    return rows.join(trades.select("trade_id", *columns), "trade_id", "left")


def session_pnl(trades: DataFrame, since: int, bot_id: str, env: str) -> DataFrame:
    mine = trades.filter((F.col("bot_id") == bot_id) & (F.col("env") == env) & F.col("exit_ts").isNotNull() & (F.col("exit_ts") >= since))
    return mine.agg(F.coalesce(F.sum("pnl_net_usdt"), F.lit(0.0)).alias("session_pnl"))


def open_positions(trades: DataFrame) -> DataFrame:
    return trades.filter(F.col("exit_ts").isNull())


def session_stats(trades: DataFrame) -> DataFrame:
    """The status report's counts and rates."""
    closed, won = F.col("exit_ts").isNotNull(), F.col("pnl_net_usdt") > 0
    n_closed, n_won = F.count_if(closed), F.count_if(won)
    return trades.agg(
        F.count(F.lit(1)).alias("total_trades"), n_closed.alias("closed"), F.count_if(~closed).alias("open"), n_won.alias("wins"),
        F.round(n_won / F.nullif(n_closed, F.lit(0)) * 100, 1).alias("win_rate_pct"),
        F.round(F.coalesce(F.sum(F.when(closed, F.col("pnl_net_usdt"))), F.lit(0.0)), 4).alias("total_pnl_usdt"),
        F.round(F.coalesce(F.avg(F.when(won, F.col("pnl_pct"))), F.lit(0.0)), 2).alias("avg_win_pct"),
        F.round(F.coalesce(F.avg(F.when(~won & closed, F.col("pnl_pct"))), F.lit(0.0)), 2).alias("avg_loss_pct"))


def daily_summary(trades: DataFrame) -> DataFrame:
    """Per UTC day of exit: trades, wins, pnl, win rate, and the positions open when the day ends.

    Open positions are entries minus exits up to the day: counts per day, summed
    over days. A trade is a move of its day of entry and one of its day of exit,
    so one pass and one exchange make both. A day's pnl is added up in order of
    the trades' ids: partial sums would differ in the last digits with the rows'
    split, and so by 0.0001 where a sum's fifth decimal is a lone 5.
    """
    move = lambda at, n, pnl, done: F.struct(midnight(F.col(at)).alias("day_ts"), "trade_id", n.alias("n"), pnl.alias("pnl"), F.lit(done).alias("done"))
    closed = F.col("exit_ts").isNotNull()
    held = F.col("entry_ts").isNotNull() & F.coalesce(F.col("exit_ts") >= F.col("entry_ts"), F.lit(True))
    moves = F.array_compact(F.array(F.when(held, move("entry_ts", F.lit(1), F.lit(None).cast("double"), False)),
                                    F.when(closed, move("exit_ts", F.when(held, -1).otherwise(0), F.col("pnl_net_usdt").cast("double"), True))))
    whole = Window.partitionBy("day_ts").orderBy("trade_id", "pnl").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moves = trades.select(F.explode(moves).alias("m")).select("m.*").withColumn("total", F.sum("pnl").over(whole))
    days = moves.groupBy("day_ts").agg(F.count_if("done").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.max("total").alias("pnl"), F.sum("n").alias("n"))
    # One row per day from here on.
    upto = Window.orderBy("day_ts").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("active", F.sum("n").over(upto)).filter("trades > 0")
    return days.select("day_ts", "trades", "wins", "pnl", (F.col("wins") / F.col("trades")).alias("win_rate"), "active")


def histogram(df: DataFrame, column: str, none: str = "None") -> DataFrame:
    """Counts and percentages of a column's values."""
    counts = df.groupBy(F.coalesce(column, F.lit(none)).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def top(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """Most common values, ties by value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(n)


def stale(heartbeats: DataFrame, now: int, seconds: int = 90) -> DataFrame:
    """Latest beat per bot and whether it is too old."""
    return latest(heartbeats, ["bot_id"], "ts").withColumn("stale", (F.lit(now) - F.col("ts")) / 1000.0 > seconds)


def regime_changes(labelled: DataFrame) -> DataFrame:
    """Where a series' regime differs from its candle before: ts, the new regime and its pairs; quiet stretches count as ``None``."""
    now = F.coalesce("regime", F.lit("None"))
    before = F.lag(now).over(Window.partitionBy(*SERIES).orderBy("ts"))
    moved = labelled.select("pair", "ts", now.alias("regime"), before.alias("before")).filter("before <> regime")
    return moved.groupBy("ts", "regime").agg(F.array_sort(F.collect_set("pair")).alias("pairs"))


def save(df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append to a managed Parquet table, created on first use."""
    writer = df.write.format("parquet").mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
