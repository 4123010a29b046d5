"""Alert texts against their SQL."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from wickflow import registry
from wickflow.operators import store
from wickflow.schemas import DAY_MS


def _orders(folder, rows) -> str:
    """Orders (key, customer, price, date, priority), all of them filled."""
    df = pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]).astype({"o_orderdate": "datetime64[us]", "o_totalprice": "float64"})
    df.assign(o_orderstatus="F").to_parquet(folder / "orders.parquet")
    return str(folder)


def _both(spark, folder: str, name: str) -> tuple[dict, dict]:
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet')")
    return {r[0]: r[1] for r in registry.queries()[name](spark, folder).collect()}, dict(con.execute(registry.oracle_sql()[name]).fetchall())


def test_close_messages_of_amounts_near_zero(spark, tmp_path):
    """Amounts that round to zero, ties, prices from 1e7, a missing price and a missing pair; each as a liquidation, too."""
    prices = [149999.99, 149999.51, 149999.5, 149999.49, 150000.0, 150000.49, 150000.5, 9999999.99, 10000000.0, 123456789.12, 0.0002, 0.0, -5.0, None]
    rows = [(k * 8 + j, k + j, p, "2000-01-01", "1-URGENT") for k, p in enumerate(prices) for j in (0, 1)]
    got, want = _both(spark, _orders(tmp_path, [*rows, (900, 5, 149000.0, "2000-01-01", None)]), "close_messages")
    assert got == want and len(got) == 29
    assert "PnL: $0.0000 (-0.00%)" in got[0] and "Loss: $0.0000" in got[1] and "PnL: $-0.0001 " in got[16]
    assert "Exit: 10000000.0 " in got[64] and got[104] is got[105] is got[900] is None


def test_daily_messages_of_sums_near_zero(spark, tmp_path):
    """Days whose sum rounds to zero; an order without a date is open on no day, a day without amounts has no message."""
    prices = [149999.99, 149999.9, 149999.51, 150000.0, 150000.4, 149000.0, None]
    rows = [(24 * (2 * k + j), 48 * (2 * k + j), p, f"2000-01-{1 + k:02d}", "1-URGENT") for k, p in enumerate(prices) for j in (0, 1)]
    got, want = _both(spark, _orders(tmp_path, [*rows, (960, 48, 149000.0, None, "1-URGENT")]), "daily_messages")
    assert got == want and len(got) == 7
    first, *_, last = (got[d] for d in sorted(got))
    assert first.endswith("Net PnL: $0.0000\nBucket states: 0 active") and last is None


def test_daily_pnl_is_summed_in_order_of_trades(spark):
    """However rows are split; doubles whose sum depends on their order."""
    rows = [(k, k % 3 * DAY_MS, k % 3 * DAY_MS + 5, (-1.0) ** (k // 3) * 10.0 ** (k * 7 % 18) + k / 7) for k in range(600)]
    want = {}
    for _, _, done, pnl in rows:
        want[done - 5] = want.get(done - 5, 0.0) + pnl
    trades = spark.createDataFrame(rows, "trade_id long, entry_ts long, exit_ts long, pnl_net_usdt double")
    for split in (trades.coalesce(1), trades.repartition(7), trades.repartition(3, "pnl_net_usdt"), trades.orderBy(F.desc("trade_id"))):
        assert {r["day_ts"]: r["pnl"] for r in store.daily_summary(split).collect()} == want
