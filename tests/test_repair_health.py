"""Gaps in stored indicators, null prices, and silent bots."""

import random
import time

import pytest
import rowwise as R
from pyspark.sql import functions as F

from wickflow.operators import repair
from wickflow.operators.indicators import indicators
from wickflow.operators.signals import enrich
from wickflow.schemas import CANDLE, DAY_MS, HEARTBEAT
from wickflow.scratch import materialise
from wickflow.streaming import health


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for r in rows], CANDLE)


@pytest.fixture(scope="module")
def whole(spark):
    rng = random.Random(3)
    rows = [r for p, seed in (("BTC", 1), ("ETH", 2)) for r in R.series(700, seed, p, step=R.HOUR, timeframe="1h") if rng.random() < 0.8]
    return materialise(enrich(frame(spark, rows)), "whole")


def test_filled_gaps_equal_a_full_recompute(spark, whole):
    hour = F.floor(F.col("ts") / R.HOUR)
    lost = whole.withColumns({c: F.when((hour % 150 != k) & ((F.col("pair") != "ETH") | (hour % 300 > 20)), F.col(c)) for k, c in enumerate(repair.NAMES)})
    got = {(r["pair"], r["ts"]): r for r in repair.fill_missing(lost).collect()}
    want = whole.collect()
    assert len(got) == len(want) and lost.filter(repair.gap()).count() > 20
    for r in want:
        for c in whole.columns:
            assert got[r["pair"], r["ts"]][c] == (pytest.approx(r[c], abs=1e-9) if isinstance(r[c], float) else r[c])


def test_only_frames_that_feed_a_gap_are_read(spark, whole):
    at = whole.filter("pair = 'BTC'").agg(F.percentile("ts", 0.6).alias("m")).first()["m"] // DAY_MS
    lost = whole.withColumn("adx", F.when(F.floor(F.col("ts") / DAY_MS) != int(at), F.col("adx")))
    days = repair.needed_days(lost)
    read = whole.withColumn("day", F.floor(F.col("ts") / DAY_MS)).join(days, ["bot_id", "pair", "timeframe", "day"], "left_semi").groupBy("pair").count().collect()
    assert all(119 <= r["count"] <= 119 + 2 * 24 for r in read) and days.filter("own").count() == 2
    untouched = lost.filter("adx is not null").withColumn("adx", F.lit(-1.0))
    assert repair.fill_missing(untouched).filter("adx <> -1").count() == 0


def test_nulls_spoil_only_their_frames(spark):
    rows = [r | ({"close": None} if k == 30 else {"volume": None} if k == 60 else {}) for k, r in enumerate(R.series(300, 5))]
    got = indicators(frame(spark, rows), buffer=40).orderBy("ts").collect()
    for name, bad, reach in (("ema9", 30, 40), ("atr14", 30, 40), ("adx", 30, 40), ("bb_upper", 30, 20), ("volume_ma20", 60, 20), ("volume_ratio", 60, 20)):
        nulls = [k for k, r in enumerate(got) if r[name] is None]
        assert nulls and bad <= min(nulls) and max(nulls) <= bad + reach, name
    want = indicators(frame(spark, R.series(300, 5)), buffer=40).orderBy("ts").collect()
    assert [r["adx"] for r in got[75:]] == [r["adx"] for r in want[75:]]


def beats(spark, folder, *items):
    spark.createDataFrame([(b, ts, 1, "ok", None) for b, ts in items], HEARTBEAT).coalesce(1).write.mode("append").parquet(folder)


def test_a_silent_bot_turns_stale_and_comes_back(spark, tmp_path):
    source, told = str(tmp_path / "in"), []
    beats(spark, source, ("a", 1), ("b", 5), ("a", 3))
    listener = health.Beats(told.append, lambda: int(time.time() * 1000))
    spark.streams.addListener(listener)
    stream = health.watch(spark.readStream.schema(HEARTBEAT).parquet(source), seconds=20)
    q = stream.writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    rows = lambda: sorted((r["bot_id"], r["state"], r["ts"]) for r in spark.sql("SELECT * FROM watched").collect())

    try:
        end = time.time() + 150
        while not {("a", "stale", 3), ("b", "stale", 5)} <= set(rows()) and time.time() < end:
            beats(spark, source, ("live", int(time.time() * 1000)))  # timers fire with batches, and a live bot brings these
            time.sleep(4)
        assert {("a", "alive", 3), ("b", "alive", 5), ("a", "stale", 3), ("b", "stale", 5)} <= set(rows())
        silent = spark.sql("SELECT min(silent_ms) FROM watched WHERE state = 'stale'").first()[0]
        assert silent >= 20_000
        beats(spark, source, ("b", 9))
        end = time.time() + 60
        while ("b", "alive", 9) not in rows() and time.time() < end:
            time.sleep(2)
        assert ("b", "alive", 9) in rows()
    finally:
        q.stop()
        time.sleep(1)
        spark.streams.removeListener(listener)
    assert {x["status"] for x in told} >= {"started", "running"} and any(x["bot_id"] == "watched" for x in told)
