"""Performance metrics of trades, and their comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.operators.prefix import CHUNK_ROWS, cut, running, whole

#: Five-minute bars in a year.
PERIODS = 105_120
#: Compared metrics; true: higher is better.
COMPARED = {"win_rate": True, "total_pnl_usdt": True, "sharpe_ratio": True, "max_drawdown_pct": False, "profit_factor": True}


def drawdowns(trades: DataFrame, by: list[str], order: list[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Trades with running equity, its peak (never below 0) and the drawdown; groups of over ``rows`` trades in chunks."""
    df = running(cut(trades, by, order[0], rows), by, order, {"equity": ("sum", F.col("pnl_net_usdt"))})
    df = whole(running(df, by, order, {"peak": ("max", F.col("equity"))}))
    df = df.withColumn("peak", F.greatest(F.col("peak"), F.lit(0.0)))
    return df.withColumn("drawdown", F.col("peak") - F.col("equity"))


def summary(trades: DataFrame, by: list[str], order: list[str], keep: DataFrame | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """All metrics per group, unrounded; ``keep`` lists groups that get a zero row without trades."""
    df = drawdowns(trades, by, order, rows)
    pnl = F.col("pnl_net_usdt")
    win, loss = F.when(pnl > 0, pnl), F.when(pnl <= 0, pnl)
    n, wins = F.count(F.lit(1)), F.count(win)
    # The final peak is the largest.
    out = df.groupBy(*by).agg(
        n.alias("total_trades"), wins.alias("win_count"), F.count(loss).alias("loss_count"), (wins / n).alias("win_rate"), F.sum(pnl).alias("total_pnl_usdt"),
        F.avg(pnl).alias("avg_pnl_usdt"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win_usdt"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss_usdt"),
        F.abs(F.coalesce(F.sum(win), F.lit(0.0))).alias("gain"), F.abs(F.sum(loss)).alias("pain"), F.avg("pnl_pct").alias("mean_pct"), F.stddev_samp("pnl_pct").alias("sd_pct"),
        F.max("drawdown").alias("max_drawdown_usdt"), F.max("peak").alias("peak"), F.avg(F.coalesce(F.col("hold_candles"), F.lit(0))).alias("avg_hold_candles"))
    out = out.withColumns({
        "profit_factor": F.when(F.col("pain") > 0, F.col("gain") / F.when(F.col("pain") > 0, F.col("pain"))),
        "sharpe_ratio": F.when((F.col("total_trades") >= 2) & (F.col("sd_pct") > 0), F.col("mean_pct") / F.when(F.col("sd_pct") > 0, F.col("sd_pct")) * math.sqrt(PERIODS)).otherwise(0.0),
        "max_drawdown_pct": F.when(F.col("peak") > 0, F.col("max_drawdown_usdt") / F.when(F.col("peak") > 0, F.col("peak")) * 100.0).otherwise(0.0)})
    out = out.drop("gain", "pain", "mean_pct", "sd_pct", "peak")
    if keep is not None:
        zero = {c: (0 if c in ("total_trades", "win_count", "loss_count") else 0.0) for c in out.columns if c not in (*by, "profit_factor")}
        out = keep.join(out, by, "left").fillna(zero)
    return out


def report(metrics: DataFrame) -> DataFrame:
    """Metrics rounded as reported."""
    places = {"profit_factor": 3, "sharpe_ratio": 3, "avg_hold_candles": 2}
    return metrics.withColumns({c: F.round(c, places.get(c, 4)) for c, t in metrics.dtypes if t == "double"})


def close_reasons(trades: DataFrame, by: list[str]) -> DataFrame:
    """Histogram of close reasons as a map per group."""
    counts = trades.groupBy(*by, F.coalesce("close_reason", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("close_reasons"))


def compare(baseline: DataFrame, candidate: DataFrame, by: list[str], threshold: float = 0.05) -> DataFrame:
    """Verdict per metric (improve, hold, regress) in long form, and over all of them."""
    b = baseline.select(*by, *[F.col(m).alias(f"b_{m}") for m in COMPARED])
    c = candidate.select(*by, *[F.col(m).alias(f"c_{m}") for m in COMPARED])
    rows = b.join(c, by).select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(f"b_{m}").alias("baseline"), F.col(f"c_{m}").alias("candidate")) for m, up in COMPARED.items()])).alias("x"))
    delta = (F.col("x.candidate") - F.col("x.baseline")) / F.abs(F.when(F.col("x.baseline") != 0, F.col("x.baseline")))
    gain = F.when(F.col("x.up"), delta).otherwise(-delta)
    judged = rows.select(*by, F.col("x.metric").alias("metric"), F.col("x.baseline").alias("baseline"), F.col("x.candidate").alias("candidate"),
                         F.when(gain.isNull(), "hold").when(gain >= 0, "improve").when(gain < -threshold, "regress").otherwise("hold").alias("result"))
    worse = F.max(F.when(F.col("result") == "regress", 1).otherwise(0)).over(Window.partitionBy(*by))
    return judged.withColumn("verdict", F.when(worse == 1, "REJECT").otherwise("ACCEPT"))


#: Least (or, where marked, most) values for going live: the short synthetic run and the run of ninety days.
SHORT_RUN = (("total_trades", ">=", 5.0), ("win_rate", ">=", 0.55), ("profit_factor", ">=", 1.2))
LONG_RUN = (("win_rate", ">=", 0.55), ("avg_pnl_usdt", ">=", 0.018), ("max_drawdown_pct", "<=", 30.0), ("sharpe_ratio", ">", 0.0), ("total_trades", ">=", 20.0))


def go_live(summary: DataFrame, by: list[str], checks: tuple[tuple[str, str, float], ...] = LONG_RUN) -> DataFrame:
    """PASS or FAIL per check in long form, and the verdict over all of them; a missing value fails."""
    row = lambda m, op, limit: F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.coalesce(F.expr(f"{m} {op} {limit}D"), F.lit(False)).alias("ok"))
    rows = summary.select(*by, F.array(*[row(*c) for c in checks]).alias("x"))
    verdict = F.when(F.forall("x", lambda c: c["ok"]), "GO").otherwise("NO-GO")
    return rows.select(*by, verdict.alias("verdict"), F.explode("x").alias("c")).select(
        *by, F.col("c.metric").alias("metric"), F.col("c.value").alias("value"), F.when(F.col("c.ok"), "PASS").otherwise("FAIL").alias("result"), "verdict")
