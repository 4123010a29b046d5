"""Paged history: gaps, failover, resume, follow mode."""

import json

import pytest
import rowwise as R

from wickflow.sources import pages
from wickflow.sources.pages import CandlePages, write_pages
from wickflow.schemas import CANDLE

H = R.HOUR
T0 = 1_736_154_000_000 // (50 * H) * 50 * H


@pytest.fixture(scope="module")
def rows(spark):
    from wickflow.scratch import ship

    ship(spark)
    spark.dataSource.register(CandlePages)
    return R.series(400, 3, "p", T0, H, "1h")


def write(folder, rows, per_page, skip=()):
    folder.mkdir(exist_ok=True)
    found = {}
    for r in rows:
        found.setdefault(r["ts"] // (per_page * H) * per_page * H, []).append([r[c] for c in ("ts", "open", "high", "low", "close", "volume")])
    for first, page in found.items():
        if first not in skip:
            (folder / f"page-{first}.json").write_text(json.dumps(page))


def load(spark, folders, **options):
    base = {"roots": ",".join(f"file://{f}" for f in folders), "timeframe": "1h", "pair": "p", "now": str(T0 + 1000 * H)} | options
    return {r["ts"]: r["close"] for r in spark.read.format("candle_pages").options(**base).load().collect()}


def test_failover_fills_missing_broken_and_gapped_pages(spark, rows, tmp_path):
    a, b, c = (tmp_path / x for x in "abc")
    mine = [r | {"close": 1.0} for k, r in enumerate(rows) if k % 9]  # gaps
    write(a, mine, 50, skip={T0 + 100 * H})
    (a / f"page-{T0 + 200 * H}.json").write_text('[[1, 2')
    (a / "notes.txt").write_text("no page")
    write(b, [r | {"close": 2.0} for r in rows if r["ts"] != T0 + 9 * H], 80)
    write(c, [r | {"close": 3.0} for r in rows], 400)
    got = load(spark, [tmp_path / "nothing", a, b, c], pagespertask="2")
    want = {}
    for k, r in enumerate(rows):
        lost = 100 <= k < 150 or 200 <= k < 250 or k % 9 == 0
        want[r["ts"]] = (3.0 if k == 9 else 2.0) if lost else 1.0
    assert got == want
    assert load(spark, [a]) == {t: v for t, v in want.items() if v == 1.0}


def test_resume_and_the_last_two_candles(spark, rows, tmp_path):
    write(tmp_path / "a", rows, 50)
    got = load(spark, [tmp_path / "a"], since=str(T0 + 70 * H), now=str(T0 + 300 * H + 5))
    assert sorted(got) == [T0 + k * H for k in range(70, 299)]
    assert load(spark, [tmp_path / "none"]) == {}


def test_follow_mode_goes_on_from_its_checkpoint(spark, rows, tmp_path):
    folder = tmp_path / "a"
    write(folder, rows[:120], 50)

    def follow():
        stream = spark.readStream.format("candle_pages").options(roots=f"file://{folder}", timeframe="1h", pair="p", now=str(T0 + 1000 * H)).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return [r["ts"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()]

    assert follow() == [r["ts"] for r in rows[:120]]
    assert follow() == [r["ts"] for r in rows[:120]]
    write(folder, rows[:333], 50)  # the newest page grows, new ones follow
    assert follow() == [r["ts"] for r in rows[:333]]


def test_written_pages_read_back(spark, rows, tmp_path):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in CANDLE.split(", ")) for r in rows], CANDLE)
    write_pages(df, f"file://{tmp_path}/w", 70)
    assert load(spark, [tmp_path / "w"]) == {r["ts"]: r["close"] for r in rows}
    assert pages._rows(f"file://{tmp_path}/w/none.json") == {}
