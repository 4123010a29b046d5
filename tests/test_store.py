"""Store operations, sources, streaming and the SQL twins."""

import glob
import json
import os
import random

import duckdb
import pandas as pd
import pytest
import rowwise as R
from pyspark.sql import functions as F

from wickflow import registry, scratch
from wickflow.operators import memory, risk, store
from wickflow.schemas import CANDLE, DAY_MS, HOUR_MS
from wickflow.sources.candles import duration_seconds, read_ohlcv_json, recent
from wickflow.streaming.trading import position_updates

DATA = "/root/testdata/sf0.001"


def _frame(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)).astype(object)
        df[c] = df[c].map(lambda v: "null" if v is None else repr(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", ["candles_1h", "geometry_columns", "all_indicators", "regime_histogram", "evaluate_signals", "trade_exits", "metrics_basic", "compare_metrics",
                                  "candle_upsert", "trade_context_range", "memory_adjust", "latest_heartbeat", "event_log_filter", "stream_candles"])
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(_frame(got), _frame(want))


def _lively_events(folder, series: tuple[tuple[int, str], ...], candles: int) -> str:
    """Events whose hourly candles are lively series (seed, pair), so that patterns fire and trades open."""
    rows = []
    for seed, pair in series:
        for c in R.series(candles, seed, pair, 1_736_154_000_000 // HOUR_MS * HOUR_MS, HOUR_MS, "1h"):
            n = max(4, round(c["volume"] / 20))
            for k, v in enumerate([c["open"], c["high"], c["low"], *[c["close"]] * (n - 3)]):
                rows.append((len(rows), pd.Timestamp(c["ts"] + 1000 * k, unit="ms"), 1, pair, v, "{}"))
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def lively(tmp_path_factory):
    return _lively_events(tmp_path_factory.mktemp("lively"), ((1, "BTC"), (5, "ETH")), 700)


def _as_twin(spark, folder: str, name: str) -> pd.DataFrame:
    """A query's rows, after they were found equal to its twin's."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    got, want = registry.queries()[name](spark, folder).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(_frame(got), _frame(want))
    return got


@pytest.mark.parametrize(("name", "fires"), [("pat_impulse", "fired"), ("pat_wick", "fired"), ("pat_momentum", "fired"), ("pat_anomaly", "fired"), ("pattern_scan", "pattern"), ("evaluate_signals", "pattern"),
                                             ("backtest_trades", "pair"), ("backtest_signal_log", "pattern"), ("memory_signals", "best_pattern"), ("pat_compression", "pair")])
def test_sql_twin_on_a_lively_series(spark, lively, name, fires):
    got = _as_twin(spark, lively, name)
    assert (got[fires] != False).sum() > 3 and got[fires].replace(False, None).notna().sum() > 3  # noqa: E712


def test_walk_forward_twins_on_lively_series(spark, tmp_path):
    """Either side of the split trades; the tuning query compares every metric of each pair."""
    folder = _lively_events(tmp_path, ((1, "BTC"), (5, "ETH"), (9, "SOL")), 1600)
    got = _as_twin(spark, folder, "walk_forward_metrics")
    assert len(got) == 6 and (got.groupby("fold")["total_trades"].sum() > 3).all()
    got = _as_twin(spark, folder, "tune_grid")
    assert len(got) == 15 and (got["candidate"].fillna(0) != 0).sum() > 3


def test_upsert_keeps_first_env(spark):
    base = [("dev-1", "p", "5m", 1, 1.0, 1.0, 1.0, 1.0, 1.0)]
    stored = spark.createDataFrame(base, CANDLE).withColumn("env", F.lit("prod"))
    new = spark.createDataFrame([("dev-1", "p", "5m", 1, 2.0, 2.0, 2.0, 2.0, 2.0), ("x-1", "p", "5m", 1, 3.0, 3.0, 3.0, 3.0, 3.0)], CANDLE)
    got = {r["bot_id"]: (r["close"], r["env"]) for r in store.upsert_candles(stored, new).collect()}
    assert got == {"dev-1": (2.0, "prod"), "x-1": (3.0, "prod")}


def test_close_and_reports(spark):
    opened = spark.createDataFrame([(1, 5, None, None), (2, 6, None, None)], "trade_id long, entry_ts long, exit_ts long, pnl_net_usdt double")
    done = spark.createDataFrame([(1, 9, 2.5, "timeout")], "trade_id long, exit_ts long, pnl_net_usdt double, close_reason string")
    got = {r["trade_id"]: r for r in store.close_trades(opened, done).collect()}
    assert got[1]["exit_ts"] == 9 and got[1]["close_reason"] == "timeout" and got[2]["exit_ts"] is None
    assert store.open_positions(store.close_trades(opened, done)).count() == 1


def test_memory(spark):
    rows = [("w", "long", "us", "RANGING", k, 1.0 if k % 4 else -1.0, 0.33333 * k) for k in range(24)]
    t = spark.createDataFrame(rows, "pattern string, direction string, session string, regime string, exit_ts long, pnl_net_usdt double, pnl_pct double")
    s = memory.stats(t).first()
    assert (s["sample_count"], s["win_count"], s["win_rate"]) == (24, 18, 0.75)
    avg = 0.0
    for n, r in enumerate(rows, 1):
        avg = round((avg * (n - 1) + r[-1]) / n, 4)
    grown = memory.stepwise(t.repartition(5)).first()
    assert (grown["avg_pnl_pct"], grown["win_rate"], grown["sample_count"], grown["last_updated"]) == (avg, 0.75, 24, 23)
    assert memory.stepwise(t.limit(0)).count() == 0
    cases = spark.createDataFrame([(0.6, 9, 0.1), (0.6, 10, 0.9), (0.6, 10, None), (0.2, 30, 0.0), (1.0, 30, 1.0)], "raw double, n int, wr double")
    got = [r[0] for r in cases.select(memory.adjust(F.col("raw"), F.col("n"), F.col("wr"))).collect()]
    assert got == [0.6, 0.69, 0.6, 0.3, 0.95]


def test_memory_at_time_sees_no_later_trade(spark):
    """Counts of each row equal a count over the trades that closed before it, on keys that hold most trades."""
    rng = random.Random(6)
    trades = [(rng.choice("aaab"), rng.choice(["long", "short", None]), rng.choice([None, *range(0, 20 * DAY_MS, DAY_MS // 3)]), rng.choice([-1.0, 2.0, None])) for _ in range(900)]
    rows = [(k, rng.choice("aabc"), rng.choice(["long", "short", None]), rng.randrange(0, 22 * DAY_MS, DAY_MS // 3)) for k in range(300)]
    t = spark.createDataFrame(trades, "pattern string, direction string, exit_ts long, pnl_net_usdt double")
    got = memory.at_time(spark.createDataFrame(rows, "id int, pattern string, direction string, ts long"), t).collect()
    assert len(got) == len(rows)
    for r in got:
        past = [x for x in trades if x[:2] == (r["pattern"], r["direction"]) and x[2] is not None and x[2] < r["ts"]]
        wins = sum((x[3] or 0) > 0 for x in past)
        assert (r["sample_count"], r["win_count"]) == (len(past), wins) and r["win_rate"] == (pytest.approx(wins / len(past), abs=5.1e-5) if past else None)


def test_memory_merge_matches_whole(spark):
    rows = [("w", "long", "us", "RANGING", k, 1.0 if k % 3 else -1.0, float(k)) for k in range(12)]
    t = spark.createDataFrame(rows, "pattern string, direction string, session string, regime string, exit_ts long, pnl_net_usdt double, pnl_pct double")
    both = memory.merge(memory.stats(t.filter("exit_ts < 5")), memory.stats(t.filter("exit_ts >= 5"))).first()
    whole = memory.stats(t).first()
    assert all(both[c] == whole[c] for c in ("sample_count", "win_count", "win_rate", "avg_pnl_pct", "last_updated"))


def test_risk_order(spark):
    cases = [(1000.0, 1120.0, 900.0, 0, 0.0, None, None), (1000.0, 1010.0, 1000.0, 0, 0.0, None, "sl_distance_zero"), (1000.0, 1100.0, 900.0, 0, 0.0, None, "rr_below_minimum"),
             (1000.0, 1002.0, 999.0, 0, 0.0, None, "fee_not_viable"), (1000.0, 1120.0, 900.0, 1, 0.0, None, "bucket_limit"), (1000.0, 1120.0, 900.0, 0, -5.0, None, "daily_loss_limit"),
             (1000.0, 1120.0, 900.0, 0, 0.0, 30_000, "stale_data"), (1000.0, 1120.0, 900.0, 0, 0.0, 60_000, None)]
    df = spark.createDataFrame(cases, "e double, tp double, sl double, a int, pnl double, re long, want string")
    out = df.withColumn("got", risk.reason(F.col("e"), F.col("tp"), F.col("sl"), F.lit("long"), 20, F.col("a"), F.col("pnl"), F.col("re")))
    assert all(r["got"] == r["want"] for r in out.collect())


def test_sessions(spark):
    from wickflow.functions.candle import session

    df = spark.createDataFrame([(h * HOUR_MS, R.session(h * HOUR_MS)) for h in range(24)], "ts long, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", session(F.col("ts"))).collect())


def test_ohlcv_json_and_recent(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([[k * HOUR_MS, 1, 2, 0.5, 1.5, 10] for k in range(5)]))
    df = read_ohlcv_json(spark, str(tmp_path / "c.json"), "p", "1h")
    assert [r["ts"] for r in recent(df, 2).orderBy("ts").collect()] == [3 * HOUR_MS, 4 * HOUR_MS]
    assert [duration_seconds(x) for x in ("7d", "1h", "30m", "x")] == [604_800, 3_600, 1_800, 3_600]


def test_retention_boundary(spark):
    now = 100 * DAY_MS
    c = spark.createDataFrame([(10 * DAY_MS - 1, "a"), (10 * DAY_MS, "b"), (5, "c")], "ts long, candle_id string")
    ctx = spark.createDataFrame([("c",)], "candle_id string")
    assert [r["candle_id"] for r in store.expired_candles(c, ctx, now).collect()] == ["a"]


_POSITION = ("bot_id string, pair string, timeframe string, ts bigint, high double, low double, close double, outcome string, side string, entry_price double, tp_price double, sl_price double, size_usdt double, "
             "since_reconnect_ms bigint")


def _positions(spark, folder, rows: list[tuple], cols: str = _POSITION) -> list[tuple]:
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(folder / "in"))
    name = f"positions_{folder.name.replace('-', '_')}"
    q = position_updates(spark.readStream.schema(cols).parquet(str(folder / "in"))).writeStream.format("memory").queryName(name).option(
        "checkpointLocation", str(folder / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [(r["ts"], r["event"], r["reason"]) for r in spark.sql(f"SELECT * FROM {name} ORDER BY ts").collect()]


def test_positions_stream(spark, tmp_path):
    """Keyed positions open, close and respect the one-position rule."""
    rows = [("b", "p", "5m", 1, 100.0, 100.0, 100.0, "fired", "long", 100.0, 102.0, 99.0, 10.0), ("b", "p", "5m", 2, 101.0, 99.5, 100.0, "fired", "long", 100.0, 102.0, 99.0, 10.0),
            ("b", "p", "5m", 3, 103.0, 100.0, 102.0, "rejected", None, None, None, None, None)]
    assert _positions(spark, tmp_path, rows, _POSITION.rsplit(",", 1)[0]) == [(1, "open", None), (3, "close", "take_profit")]


def test_positions_stream_passes_the_risk_gates(spark, tmp_path):
    """Reward below risk, a fee that eats the gain, and a feed that just came back open nothing."""
    entry = lambda ts, tp, sl, since: ("b", "p", "5m", ts, 100.0, 100.0, 100.0, "fired", "long", 100.0, tp, sl, 10.0, since)
    rows = [entry(1, 101.0, 99.0, None), entry(2, 100.2, 99.9, None), entry(3, 102.0, 99.0, 59_999), entry(4, 102.0, 99.0, 60_000)]
    assert _positions(spark, tmp_path, rows) == [(4, "open", None)]


class _Cluster:
    """A session of a cluster without a shared folder."""

    class sparkContext:
        applicationId, master = "app-1", "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class conf:
        get = staticmethod(lambda key, default=None: default)


def test_scratch_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_uri(_Cluster, "x")


def test_scratch_honours_the_contexts_checkpoint_folder(monkeypatch):
    monkeypatch.setattr(_Cluster.sparkContext, "getCheckpointDir", staticmethod(lambda: "file:/shared/x/"))
    assert scratch.scratch_root(_Cluster) == "file:///shared/x/wickflow-app-1"


def test_scratch_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_root", lambda _: f"file://{tmp_path}/own")
    df = scratch.materialise(spark.range(3), "t")
    assert df.count() == 3 and list((tmp_path / "own").iterdir())
    scratch.remove_scratch(spark)
    assert not (tmp_path / "own").exists()
    scratch.remove_scratch(spark)
