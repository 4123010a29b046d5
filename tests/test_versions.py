"""The merge-on-read store and retention by days."""

import os

from pyspark.sql import functions as F

from wickflow.operators import memory, store, versions
from wickflow.schemas import CANDLE, DAY_MS

SCHEMA = CANDLE + ", env string"


def rows(spark, *items):
    """(bot, ts, close)"""
    return spark.createDataFrame([(b, "p", "5m", ts, c, c, c, c, 1.0) for b, ts, c in items], CANDLE)


def seen(df):
    return sorted((r["bot_id"], r["ts"], r["close"], r["env"]) for r in df.collect())


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_replay_and_compaction_keep_results(spark, tmp_path):
    held = versions.VersionStore(str(tmp_path / "t"), SCHEMA)
    assert held.read(spark).count() == 0 and held.compact(spark) == -1
    held.write(rows(spark, ("dev-1", 1, 1.0), ("x", DAY_MS + 5, 1.0)).withColumn("env", F.lit("seed")), 0)
    held.write(rows(spark, ("dev-1", 1, 2.0), ("dev-1", 2, 5.0)), 1)
    want = [("dev-1", 1, 2.0, "seed"), ("dev-1", 2, 5.0, "dev"), ("x", DAY_MS + 5, 1.0, "seed")]
    assert seen(held.read(spark)) == want
    held.write(rows(spark, ("dev-1", 1, 2.0), ("dev-1", 2, 5.0)), 1)
    assert seen(held.read(spark)) == want
    assert held.compact(spark) == 1 and held.compact(spark) == 1 and seen(held.read(spark)) == want
    held.write(rows(spark, ("dev-1", 1, 2.0), ("dev-1", 2, 5.0)), 1)  # a replay of what the base has
    held.write(rows(spark, ("x", DAY_MS + 5, 9.0), ("y", 7, 3.0)), 2)
    want = [*want[:2], ("x", DAY_MS + 5, 9.0, "seed"), ("y", 7, 3.0, "prod")]
    assert seen(held.read(spark)) == want
    held.vacuum(spark)
    assert seen(held.read(spark)) == want and not (tmp_path / "t/delta/v=0").exists()
    (tmp_path / "t/base/v=2").mkdir()  # a compaction that broke off
    assert seen(held.read(spark)) == want and held.compact(spark) == 2 and seen(held.read(spark)) == want
    assert seen(held.read(spark, first_day=1)) == [want[2]]
    plan = held.read(spark, first_day=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_memory_adds_up_over_versions(spark, tmp_path):
    trades = spark.createDataFrame([("w", "long", "us", "RANGING", k, 1.0 if k % 3 else -1.0, float(k)) for k in range(30)], "pattern string, direction string, session string, regime string, exit_ts long, pnl_net_usdt double, pnl_pct double")
    held = versions.VersionStore(str(tmp_path / "m"), "pattern string, direction string, session string, regime string, sample_count bigint, win_count bigint, avg_pnl_pct double, last_updated bigint, win_rate double",
                                 versions.summed_memory, "last_updated")
    for v, part in enumerate(("exit_ts < 9", "exit_ts >= 9 and exit_ts < 20", "exit_ts >= 20")):
        held.write(memory.stats(trades.filter(part)), v)
        if v == 1:
            held.compact(spark)
    got, want = held.read(spark).first(), memory.stats(trades).first()
    assert all(got[c] == want[c] for c in ("sample_count", "win_count", "win_rate", "avg_pnl_pct", "last_updated"))


def test_retention_leaves_untouched_days_alone(spark, tmp_path):
    root, now = str(tmp_path / "c"), 100 * DAY_MS + 500
    ids = [(f"{d}-{k}", d * DAY_MS + k) for d in (3, 7, 9, 10, 11, 50) for k in (0, 400, 600)]
    c = spark.createDataFrame(ids, "candle_id string, ts long").withColumn("day", F.floor(F.col("ts") / DAY_MS))
    c.repartition("day").write.partitionBy("day").parquet(root)
    context = spark.createDataFrame([("7-400",), ("50-0",), ("none",)], "candle_id string")
    before = files(root)
    want = {r["candle_id"] for r in c.join(store.expired_candles(c, context, now).select("candle_id"), "candle_id", "left_anti").collect()}
    done = versions.expire_days(spark, root, now, 90, context)
    assert {r["candle_id"] for r in spark.read.parquet(root).collect()} == want == {"7-400", "10-600", *(f"{d}-{k}" for d in (11, 50) for k in (0, 400, 600))}
    assert done == {"dropped": 2, "rewritten": 2, "untouched": 2}
    after = files(root)
    assert all(after[f] == t for f, t in before.items() if "day=11/" in f or "day=50/" in f) and not any("day=3/" in f or "day=9/" in f for f in after)
    assert versions.expire_days(spark, root, now - 95 * DAY_MS, 90)["untouched"] == 4
