"""The stream from candles to trades against the batch run."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
import rowwise as R
from pyspark.sql import functions as F

from wickflow.operators import backtest
from wickflow.operators.signals import enrich, enrich_framed, evaluate
from wickflow.params import Params
from wickflow.schemas import CANDLE
from wickflow.streaming import trading

LOOSE = Params(body_ratio_min=0.3, wick_ratio_min=1.0, compression_factor=0.9, anomaly_volume_stddev=0.5, anomaly_price_atr=0.5, retracement_min=0.1, retracement_max=0.9,
               volume_ratio_min=1.0, min_confidence=0.4, adx_trend_min=15.0)
SERIES = {"BTC": R.series(900, 1, "BTC"), "ETH": R.series(700, 2, "ETH"), "SOL": R.series(420, 3, "SOL")}


def frame(spark, rows, cut=None):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for r in rows], CANDLE)


class Feed:
    """Candles that arrive as files, one micro-batch each."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.source, self.root, self.checkpoint = (str(folder / x) for x in ("in", "out", "cp"))

    def add(self, rows):
        frame(self.spark, rows).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, build, root=None):
        stream = self.spark.readStream.schema(CANDLE).option("maxFilesPerTrigger", 1).parquet(self.source)
        q = trading.start(build(stream), root or self.root, self.checkpoint)
        q.awaitTermination()
        return q


@pytest.fixture(scope="module")
def every():
    return [r for rows in SERIES.values() for r in rows]


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory, every):
    """Three micro-batches, the last after a restart, with repeats and a late candle."""
    feed = Feed(spark, tmp_path_factory.mktemp("feed"))
    order = sorted(every, key=lambda r: r["ts"])
    a, b = len(order) // 3, 2 * len(order) // 3
    feed.add(order[:a])
    feed.run(lambda s: trading.trading(s, LOOSE))
    feed.add(order[a:b] + order[a - 2:a] + order[5:6])
    feed.run(lambda s: trading.trading(s, LOOSE))
    feed.add(order[b:])
    feed.last = feed.run(lambda s: trading.trading(s, LOOSE))
    return feed


def rounded(df):
    names = sorted(df.columns)
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in (r[c] for c in names)) for r in df.collect())


def test_stream_trades_equal_batch_trades(spark, streamed, every):
    run = backtest.backtest(enrich_framed(frame(spark, every), LOOSE), LOOSE)
    want = backtest.trades(run).filter("not forced").drop("forced")
    got = trading.trades(spark, streamed.root)
    assert rounded(got) == rounded(want.select(*got.columns)) and want.count() > 20
    log = trading.signal_log(spark, streamed.root)
    assert rounded(log) == rounded(backtest.signal_log(run).select(*log.columns))
    assert trading.committed(spark, streamed.root, "candle").count() == len(every)
    still_open = backtest.trades(run).filter("forced").count()
    assert trading.committed(spark, streamed.root, "position").count() == want.count() + still_open


def test_no_batch_reads_a_store(spark, streamed):
    """The plan of a batch scans the new files and nothing else; two keyed operators follow one another."""
    plan = streamed.last._jsq.explainInternal(False)
    assert plan.count("transformWithStateInPandas") + plan.count("TransformWithStateInPySpark") >= 2
    assert plan.count("FileScan") == 1 and "Window" not in plan


def test_a_replayed_batch_changes_nothing(spark, streamed):
    before = rounded(trading.committed(spark, streamed.root, "trade"))
    again = trading.committed(spark, streamed.root, "trade").filter("batch = 0").drop("batch").unionByName(trading.committed(spark, streamed.root, "log").filter("batch = 0").drop("batch"))
    rest = trading.committed(spark, streamed.root, "candle").filter("batch = 0").drop("batch").unionByName(trading.committed(spark, streamed.root, "position").filter("batch = 0").drop("batch"))
    rows = again.unionByName(rest)
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    trading.commit(streamed.root)(kept, 0)
    assert rounded(trading.committed(spark, streamed.root, "trade")) == before


def test_state_starts_from_a_store(spark, tmp_path):
    """Signals of new candles equal those of one batch job over stored and new ones."""
    rows = SERIES["BTC"]
    stored, new = rows[:520], rows[520:640]
    feed = Feed(spark, tmp_path)
    feed.add(new)
    feed.run(lambda s: trading.signals(s, LOOSE, frame(spark, stored)).withColumn("kind", F.lit("signal")))
    cols = ("ts", "outcome", "stage", "reason", "regime", "pattern", "side", "confidence", "tp_price", "ema9", "adx", "rn")
    got = spark.read.parquet(feed.root).select(*cols)
    want = evaluate(enrich(frame(spark, rows[:640]), LOOSE), LOOSE).filter(F.col("ts") >= new[0]["ts"]).select(*cols)
    assert rounded(got) == rounded(want) and got.count() == 120


def test_stale_data_and_close_exits(spark, tmp_path):
    rows = SERIES["ETH"]
    schema = CANDLE + ", since_reconnect_ms bigint"
    source = str(tmp_path / "in")
    frame(spark, rows).withColumn("since_reconnect_ms", F.lit(30_000)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    trading.start(trading.trading(stream, LOOSE, exit_mode="close"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    log = trading.signal_log(spark, str(tmp_path / "out"))
    assert log.filter("reason = 'stale_data'").count() > 3 and log.filter("outcome = 'fired'").count() == 0
    assert trading.trades(spark, str(tmp_path / "out")).count() == 0
    feed = Feed(spark, tmp_path / "close")
    feed.add(rows)
    feed.run(lambda s: trading.trading(s, LOOSE, exit_mode="close", reentry_same_candle=False))
    run = backtest.backtest(enrich_framed(frame(spark, rows), LOOSE), LOOSE, exit_mode="close", reentry_same_candle=False)
    got = trading.trades(spark, feed.root)
    assert rounded(got) == rounded(backtest.trades(run).filter("not forced").select(*got.columns)) and got.count() > 5


def test_three_micro_batches_equal_one_batch_job(spark, tmp_path):
    """Every candle's signal or rejection, whether a position would be open or not."""
    rows = R.series(360, 7)
    feed = Feed(spark, tmp_path)
    for a, b in ((0, 300), (300, 330), (330, 360)):
        feed.add(rows[a:b])
        feed.run(lambda s: trading.signals(s).withColumn("kind", F.lit("signal")))
    cols = ("ts", "outcome", "stage", "reason", "regime", "pattern", "side", "confidence", "bb_width", "rsi14")
    assert rounded(spark.read.parquet(feed.root).select(*cols)) == rounded(evaluate(enrich(frame(spark, rows))).select(*cols))


def test_runs_from_any_folder(tmp_path):
    """Keyed state starts a Python worker beside the driver, which gets no shipped files."""
    root = str(Path(__file__).resolve().parent.parent)
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("trades", __spark_entry__.queries()["stream_trades"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert re.search(r"^trades \d+$", done.stdout, re.M), done.stderr[-2000:]
