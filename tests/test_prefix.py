"""Two-phase running values against plain windows."""

import random
import re

import pytest
import rowwise as R
from pyspark.sql import functions as F

from wickflow.operators import backtest, metrics, prefix
from wickflow.operators.signals import enrich_framed
from wickflow.params import Params
from wickflow.schemas import CANDLE, DAY_MS

LOOSE = Params(body_ratio_min=0.3, wick_ratio_min=1.0, compression_factor=0.9, anomaly_volume_stddev=0.5, anomaly_price_atr=0.5, retracement_min=0.1, retracement_max=0.9,
               volume_ratio_min=1.0, min_confidence=0.4, adx_trend_min=15.0)


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 40 * DAY_MS), k, None if k % 97 == 0 else rng.randint(-400, 410) / 100) for k in range(3000)]
    rows += [("hot", None, 5000, 1.0), ("alone", 5, 5001, -2.0), ("one day", 6, 5002, 1.0), *(("one day", 6 + k, 6000 + k, -1.0) for k in range(300))]
    return spark.createDataFrame(rows, "pair string, exit_ts long, trade_id long, pnl_net_usdt double")


@pytest.mark.parametrize("rows", [40, 333, 2000])
def test_chunks_equal_one_window(trades, rows):
    order = ["exit_ts", "trade_id"]
    plain = {r["trade_id"]: r for r in metrics.drawdowns(trades, ["pair"], order).collect()}
    cut = {r["trade_id"]: r for r in metrics.drawdowns(trades, ["pair"], order, rows).collect()}
    assert plain.keys() == cut.keys() and "__chunk" not in next(iter(cut.values())).asDict()
    for k, r in plain.items():
        for c in ("equity", "peak", "drawdown"):
            assert cut[k][c] == (None if r[c] is None else pytest.approx(r[c], abs=1e-9)), (k, c)


def test_exclusive_values_and_numbers(trades):
    order, by = ["exit_ts", "trade_id"], ["pair"]
    values = {"before": ("max", F.col("pnl_net_usdt")), "n": ("count", F.lit(1)), "s": ("sum", F.col("trade_id"))}
    a, b = ({r["trade_id"]: (r["before"], r["n"], r["s"]) for r in prefix.running(prefix.cut(trades, by, "exit_ts", rows), by, order, values, exclusive=True).collect()} for rows in (10**9, 50))
    assert a == b and min(v[1] for v in a.values()) == 0
    numbers = prefix.numbered(prefix.cut(trades, by, "exit_ts", 50), by, order, "k").collect()
    assert sorted((r["pair"] or "", r["k"]) for r in numbers) == sorted((p or "", k + 1) for p, n in trades.groupBy("pair").count().collect() for k in range(n))


def test_no_task_holds_a_whole_group(trades):
    cut = prefix.cut(trades, ["pair"], "exit_ts", 100)
    sizes = cut.groupBy("pair", prefix.CHUNK).count().filter("pair <> 'one day'").agg(F.max("count")).first()[0]
    day = trades.filter("pair <> 'one day'").groupBy("pair", F.floor(F.col("exit_ts") / DAY_MS)).count().agg(F.max("count")).first()[0]
    assert sizes <= 100 + day < 400
    done = prefix.running(cut, ["pair"], ["exit_ts", "trade_id"], {"e": ("sum", F.col("pnl_net_usdt"))})
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", done._jdf.queryExecution().executedPlan().toString())
    assert windows and all("__chunk" in w for w in windows)


def test_backtest_in_chunks_equals_the_whole(spark):
    rows = [tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for r in R.series(1500, 4, step=R.HOUR, timeframe="1h")]
    df = enrich_framed(spark.createDataFrame(rows, CANDLE), LOOSE)
    key = lambda x: sorted(map(str, x.collect()))
    a, b = (backtest.backtest(df, LOOSE, rows=n) for n in (10**9, 60))
    assert key(backtest.trades(a)) == key(backtest.trades(b)) and key(backtest.signal_log(a)) == key(backtest.signal_log(b)) and backtest.trades(a).count() > 10
    curve = [{r["rn"]: r["equity"] for r in backtest.equity_curve(a, rows=n).collect()} for n in (10**9, 200)]
    assert curve[1] == {k: pytest.approx(v, abs=1e-9) for k, v in curve[0].items()}
    folds = [key(backtest.fold_split(df, rows=n).select("ts", "fold")) for n in (10**9, 100)]
    assert folds[0] == folds[1]
