"""Parameter trials in one plan against one run after the other."""

import pytest
import rowwise as R
from pyspark.sql import functions as F

from wickflow.operators import backtest, metrics, trials
from wickflow.operators.signals import enrich
from wickflow.params import ColumnParams, Params
from wickflow.schemas import CANDLE
from wickflow.scratch import materialise

LOOSE = Params(body_ratio_min=0.4, wick_ratio_min=1.5, compression_factor=0.7, anomaly_volume_stddev=1.5, anomaly_price_atr=1.5, retracement_min=0.2, retracement_max=0.7,
               volume_ratio_min=1.1, min_confidence=0.4, adx_trend_min=15.0)
SETS = {"baseline": LOOSE, "long hold": LOOSE.changed("max_hold_candles", 8), "momentum": LOOSE.changed("momentum_acceleration_candles", 5), "closed": LOOSE.changed("min_confidence", 0.8),
        "many": LOOSE.changed("adx_trend_min", 30.0).changed("sl_atr_multiplier", 0.6).changed("ema_slow", 50)}


@pytest.fixture(scope="module")
def enriched(spark):
    rows = [r for p, seed, n in (("BTC", 1, 800), ("ETH", 2, 700), ("few", 3, 99), ("enough", 4, 100)) for r in R.series(n, seed, p)]
    return materialise(enrich(spark.createDataFrame([tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for r in rows], CANDLE), LOOSE), "trial-test")


def test_all_sets_in_one_plan_equal_runs_of_their_own(enriched):
    cols = ("pair", "fold", "entry_ts", "exit_ts", "pattern", "close_reason", "pnl_net_usdt", "forced")
    got = backtest.trades(trials.run(enriched, SETS)).select("trial", *cols).collect()
    seen = set()
    for name, p in SETS.items():
        want = {tuple(r) for r in backtest.trades(backtest.walk_forward(enriched, p)).select(*cols).collect()}
        assert {tuple(r)[1:] for r in got if r["trial"] == name} == want
        seen.add(frozenset(want))
    assert len(seen) >= 4 and sum(map(len, seen)) > 40


def test_verdicts_and_kept_sets(enriched):
    rows = trials.judge_trials(enriched, SETS).collect()
    assert len(rows) == 4 * (len(SETS) - 1) * 5
    few = [r for r in rows if r["pair"] == "few"]
    assert {(r["verdict"], r["kept"], r["candidate"]) for r in few} == {("INSUFFICIENT", "baseline", None)} and {r["pair"] for r in rows if r["verdict"] != "INSUFFICIENT"} == {"BTC", "ETH", "enough"}
    assert {(r["verdict"], r["kept"] == r["trial"]) for r in rows if r["pair"] != "few"} <= {("ACCEPT", True), ("REJECT", False)}
    by = ["pair"]
    for name in ("long hold", "many"):
        one = []
        for p in (LOOSE, SETS[name]):
            run = backtest.walk_forward(enriched, p).filter("fold = 'out_sample' and pair in ('BTC', 'ETH')")
            one.append(metrics.summary(backtest.trades(run), by, ["exit_ts", "entry_ts"], run.select("pair").distinct()))
        want = {(r["pair"], r["metric"], r["result"], r["verdict"]) for r in metrics.compare(*one, by).collect()}
        assert {(r["pair"], r["metric"], r["result"], r["verdict"]) for r in rows if r["trial"] == name and r["pair"] in ("BTC", "ETH")} == want
    with pytest.raises(ValueError):
        trials.judge_trials(enriched, {"a": LOOSE})


def test_sets_share_one_pass_over_candles(enriched):
    plan = trials.judge(trials.with_frames(backtest.fold_split(enriched), p := ColumnParams(tuple(SETS.values()))).crossJoin(F.broadcast(trials.table(enriched.sparkSession, SETS))), p)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and text.count("BroadcastNestedLoopJoin") == 1
