"""Vectorised operators against the row-by-row simulator."""

import pytest
import rowwise as R
from pyspark.sql import functions as F

from wickflow.operators import backtest as B
from wickflow.operators import metrics as M
from wickflow.operators import signals as S
from wickflow.operators.indicators import chunks, indicators, window_ranges
from wickflow.operators.patterns import REGISTRY, detect
from wickflow.params import Params
from wickflow.schemas import CANDLE

LOOSE = Params(body_ratio_min=0.3, wick_ratio_min=1.0, compression_factor=0.9, anomaly_volume_stddev=0.5, anomaly_price_atr=0.5, retracement_min=0.1, retracement_max=0.9,
               volume_ratio_min=1.0, min_confidence=0.4, adx_trend_min=15.0)


@pytest.fixture(scope="module")
def rows():
    return {p: R.enrich(R.series(420, seed, p), LOOSE) for p, seed in (("BTC", 1), ("ETH", 2), ("SOL", 3))}


@pytest.fixture(scope="module")
def enriched(spark, rows):
    raw = [tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for v in rows.values() for r in v]
    from wickflow.scratch import materialise

    return materialise(S.enrich(spark.createDataFrame(raw, CANDLE), LOOSE), "test-enriched")


def test_indicators(enriched, rows):
    got = {(r["pair"], r["ts"]): r for r in enriched.collect()}
    for pair, series in rows.items():
        for r in series:
            g = got[pair, r["ts"]]
            for c in ("ema9", "ema21", "rsi14", "atr14", "adx", "bb_upper", "bb_lower", "bb_width", "volume_ma20", "volume_ratio", "body_ratio", "upper_wick"):
                assert g[c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), (pair, r["ts"], c)
            assert 0 <= g["rsi14"] <= 100 and 0 <= g["adx"] <= 100 + 1e-9 and g["atr14"] >= 0 and g["bb_upper"] >= g["bb_lower"] and 0 <= g["body_ratio"] <= 1


def test_patterns_fire_as_row_by_row(enriched, rows):
    got = {(r["pair"], r["ts"]): r for r in detect(window_ranges(enriched), LOOSE).collect()}
    seen = set()
    for pair, series in rows.items():
        for i in range(len(series)):
            want = R.detect(series[max(0, i - 119):i + 1], LOOSE)
            g = got[pair, series[i]["ts"]]
            for name in REGISTRY:
                hit = g[f"p_{name}"]
                assert (hit is not None) == (name in want), (pair, i, name)
                if hit is not None:
                    seen.add(name)
                    assert hit["direction"] == want[name][0]
                    assert hit["confidence"] == pytest.approx(want[name][1], abs=1.1e-3)
    assert seen == set(REGISTRY) - {"compression_breakout"}  # which has its own series below


def test_compression_breakout(spark):
    """Swings die down while the last wide one leaves the band's window, then a jump on volume."""
    closes = [1000 + (-1) ** j * 50 * 0.8 ** max(0, j - 26) for j in range(45)] + [1050.0, 1049.0]
    rows = [{"bot_id": "b", "pair": "p", "timeframe": "5m", "ts": j * R.FIVE, "open": closes[j - 1] if j else 1000.0, "close": c, "high": max(c, closes[j - 1] if j else 1000.0),
             "low": min(c, closes[j - 1] if j else 1000.0), "volume": 900.0 if j == 45 else 200 * 0.97**j} for j, c in enumerate(closes)]
    df = spark.createDataFrame([tuple(float(r[c.split()[0]]) if "double" in c else r[c.split()[0]] for c in CANDLE.split(", ")) for r in rows], CANDLE)
    got = {r["ts"]: r["p_compression_breakout"] for r in detect(window_ranges(S.enrich(df, LOOSE)), LOOSE, ("compression_breakout",)).collect()}
    series = R.enrich(rows, LOOSE)
    want = {r["ts"]: R.detect(series[max(0, i - 119):i + 1], LOOSE).get("compression_breakout") for i, r in enumerate(series)}
    assert {k: (v["direction"], v["confidence"]) for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert want[45 * R.FIVE][0] == "long"


def test_signals_and_backtest(enriched, rows):
    run = B.backtest(enriched, LOOSE)
    trades = {(t["pair"], t["entry_ts"]): t for t in B.trades(run).collect()}
    log = {(r["pair"], r["ts"]): r for r in B.signal_log(run).collect()}
    n = fired = 0
    for pair, series in rows.items():
        want, want_log = R.backtest(series, LOOSE)
        for t in want:
            g = trades[pair, t["entry_ts"]]
            for c in ("exit_ts", "direction", "pattern", "close_reason", "hold_candles"):
                assert g[c] == t[c], (pair, t, c)
            assert g["pnl_net_usdt"] == pytest.approx(t["pnl_net_usdt"], abs=2e-6)
        n += len(want)
        for ts, outcome, stage, reason in want_log:
            g = log.pop((pair, ts))
            assert (g["outcome"], g["stage"], g["reason"]) == (outcome, stage, reason), (pair, ts)
            fired += outcome == "fired"
    assert len(trades) == n and not log and n > 10 and fired >= n - 3


def test_walk_forward_keeps_frames_apart(enriched, rows):
    run = B.walk_forward(enriched, LOOSE)
    got = {(t["fold"], t["pair"], t["entry_ts"]) for t in B.trades(run).collect()}
    want = set()
    for pair, series in rows.items():
        cut = int(len(series) * 0.6)
        for fold, part in (("in_sample", series[:cut]), ("out_sample", series[cut:])):
            want |= {(fold, pair, t["entry_ts"]) for t in R.backtest(part, LOOSE)[0]}
    assert got == want


def test_daily_loss_limit(spark):
    """Candidates that always lose: the fold stops after the limit and starts anew next day."""
    day = 86_400_000
    rows = [("b", "p", "5m", k, k + 1, (k // 10) * day, ((k + 1) // 10) * day, -2.0) for k in range(30)]
    df = spark.createDataFrame(rows, "bot_id string, pair string, timeframe string, rn int, free_rn int, day long, exit_day long, pnl_net_usdt double")
    got = {r["rn"]: r["accepted"] for r in B._occupancy(df).collect()}
    state, want = {}, {}
    free = 0
    for k in range(30):
        if k < free:
            want[k] = None
            continue
        want[k] = state.get(k // 10, 0.0) > -5
        if want[k]:
            d = (k + 1) // 10
            state = {d: state.get(d, 0.0) - 2.0}
            free = k + 1
    assert got == want


def test_equity_curve(enriched):
    run = B.backtest(enriched, LOOSE)
    last = {r["pair"]: r["e"] for r in B.equity_curve(run).groupBy("pair").agg(F.max_by("equity", "rn").alias("e")).collect()}
    total = {r["pair"]: r["s"] for r in B.trades(run).filter("not forced").groupBy("pair").agg(F.sum("pnl_net_usdt").alias("s")).collect()}
    assert {k: pytest.approx(v, abs=1e-6) for k, v in total.items()} == {k: last[k] for k in total}
    plain, doubled = B.equity_curve(run).count(), B.equity_curve(run, ref_compatible=True).count()
    assert doubled - plain == B.trades(run).filter("not forced").select("pair", "exit_ts").distinct().count()


def test_chunks_give_equal_indicators(spark, rows):
    raw = [tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for r in R.series(900, 5, "BTC", step=R.HOUR)]
    df = spark.createDataFrame(raw, CANDLE)
    whole = {r["ts"]: r["adx"] for r in indicators(df).collect()}
    cut = chunks(df, 120, rows=200)
    assert cut.select("chunk").distinct().count() > 3
    parts = {r["ts"]: r["adx"] for r in indicators(cut).filter("own").collect()}
    assert parts == {k: pytest.approx(v, abs=1e-9) for k, v in whole.items()}
    pick = lambda d: {r["ts"]: (r["outcome"], r["stage"], r["reason"], r["regime"], r["pattern"]) for r in d.collect()}
    assert pick(S.evaluate_chunked(df, LOOSE, rows=200)) == pick(S.evaluate(S.enrich(df, LOOSE), LOOSE))


def test_native_folds_equal_the_arrow_pass(spark, rows):
    raw = [tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for v in rows.values() for r in v[:150]]
    df = spark.createDataFrame(raw, CANDLE)
    names = ("ema9", "ema21", "rsi14", "atr14", "adx", "bb_width", "volume_ratio", "atr14_w", "atr50_w", "atr14_prev")
    a, b = ({(r["pair"], r["ts"]): [r[c] for c in names] for r in window_ranges(indicators(df, LOOSE, native=x), native=x).collect()} for x in (True, False))
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, abs=1e-9) for k, v in a.items())


def test_small_arrow_batches_carry_context(spark, rows):
    raw = [tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for v in rows.values() for r in v]
    df = spark.createDataFrame(raw, CANDLE)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r["pair"], r["ts"]): r["adx"] for r in indicators(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert {(r["pair"], r["ts"]): r["adx"] for r in indicators(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_metrics(spark):
    pnl = [5.0, -3.0, 2.0, -4.0, 1.0]
    df = spark.createDataFrame([("p", k, x, x, 1) for k, x in enumerate(pnl)], "pair string, exit_ts long, pnl_net_usdt double, pnl_pct double, hold_candles int")
    groups = spark.createDataFrame([("p",), ("none",)], "pair string")
    got = {r["pair"]: r for r in M.summary(df, ["pair"], ["exit_ts"], groups).collect()}
    m = got["p"]
    assert (m["total_trades"], m["win_count"], m["loss_count"]) == (5, 3, 2)
    assert m["max_drawdown_usdt"] == pytest.approx(5.0) and m["profit_factor"] == pytest.approx(8 / 7)
    assert got["none"]["total_trades"] == 0 and got["none"]["profit_factor"] is None and got["none"]["sharpe_ratio"] == 0.0
    flat = df.withColumn("pnl_pct", F.lit(1.0))
    assert M.summary(flat, ["pair"], ["exit_ts"]).first()["sharpe_ratio"] == 0.0


def test_params():
    p = Params()
    raw = {k: {"value": v} for k, v in p.__dict__.items()}
    assert Params.from_dict(raw) == p
    del raw["ema_fast"], raw["rsi_low"]
    with pytest.raises(ValueError, match="ema_fast, rsi_low"):
        Params.from_dict(raw)
    assert p.changed("ema_fast", "12").ema_fast == 12
    with pytest.raises(ValueError):
        p.changed("ema_fast", 99)


def test_evaluation_is_one_pass(spark, rows):
    """One exchange, one sort and one Arrow pass from candles to signals; single indicators ask the pass for no more than themselves."""
    raw = [tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for r in rows["BTC"][:80]]
    df = spark.createDataFrame(raw, CANDLE)
    plan = S.evaluate(S.enrich_framed(df, LOOSE), LOOSE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Window" not in plan
    assert set(indicators(df, only=("rsi14",)).columns) - set(df.columns) == {"rsi14"}
    a, b = ({r["ts"]: (r["outcome"], r["reason"], r["regime"]) for r in x.collect()} for x in (S.evaluate(S.enrich_framed(df, LOOSE), LOOSE), S.evaluate_candles(df, LOOSE, rows=20)))
    assert a == b
