"""Running sums, counts and maxima over groups of any length, in two phases.

A group that is longer than ``CHUNK_ROWS`` is cut into chunks of whole days. Each
chunk runs its own window; its total joins a small table with a row per chunk,
whose running total up to the chunk before completes the chunk's values. So no
task sorts a whole group, and two passes replace one long one. Short groups keep
the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.schemas import DAY_MS
from wickflow.scratch import materialise

#: Rows that a chunk aims at. A day of a group is never cut.
CHUNK_ROWS = 500_000
#: Most rows of the table of chunks that may be broadcast; it is counted first.
BROADCAST_ROWS = 100_000
CHUNK = "__chunk"
#: How the values of a window and of earlier chunks come together.
_JOINED = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "count": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest}
_FOLD = {"sum": F.sum, "count": F.count, "max": F.max}


def cut(df: DataFrame, by: list[str], at: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` as it is, or with a chunk number and written once if a group holds more than ``rows``; ``at`` (milliseconds) leads the order."""
    # A table of no more rows than that can't hold a longer group.
    if df.count() <= rows:
        return df
    day = F.coalesce(F.floor(F.col(at) / DAY_MS), F.lit(-(1 << 40)))  # nulls come first, as they sort
    days = materialise(df.groupBy(*by, day.alias("__day")).agg(F.count(F.lit(1)).alias("__n")), "days")
    longest = days.groupBy(*by).agg(F.sum("__n").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if longest <= rows:
        return df
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = days.withColumn(CHUNK, F.floor(before / rows)).drop("__n")
    return materialise(_small_join(df.withColumn("__day", day), chunks, [*by, "__day"]).drop("__day"), "chunked")


def by_day(df: DataFrame, at: str) -> DataFrame:
    """``df`` with each UTC day of ``at`` (milliseconds) as a chunk, for groups that are long by nature."""
    return df.withColumn(CHUNK, F.coalesce(F.floor(F.col(at) / DAY_MS), F.lit(-(1 << 40))))


def _small_join(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Join with a table of few rows, keys compared with nulls equal."""
    table = table.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(on)], *[c for c in table.columns if c not in on])
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    same = [F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(on)]
    return df.join(table, same).drop(*[f"__k{k}" for k in range(len(on))])


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """Add running values: name to (``sum``, ``count`` or ``max``, of what).

    ``exclusive`` leaves the row itself out; then a group's first row has null
    (counts: 0). Rows with equal ``order`` follow one another in any order.
    """
    local = [*by, *[c for c in (CHUNK,) if c in df.columns]]
    window = Window.partitionBy(*local).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    if CHUNK not in df.columns:
        return df.withColumns({name: _FOLD[kind](what).over(window) for name, (kind, what) in values.items()})
    totals = df.groupBy(*local).agg(*[_FOLD[kind](what).alias(f"__t_{name}") for name, (kind, what) in values.items()])
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # Earlier counts add up.
    total = {name: F.sum if kind == "count" else _FOLD[kind] for name, (kind, _) in values.items()}
    totals = materialise(totals.select(*local, *[total[name](f"__t_{name}").over(earlier).alias(f"__e_{name}") for name in values]), "chunk-totals")
    met = _small_join(df.withColumns({name: _FOLD[kind](what).over(window) for name, (kind, what) in values.items()}), totals, local)
    done = {}
    for name, (kind, _) in values.items():
        own, past = F.col(name), F.col(f"__e_{name}")
        done[name] = _JOINED[kind](own, past) if kind != "sum" else F.coalesce(own + past, own, past)
    return met.withColumns(done).drop(*[f"__e_{name}" for name in values])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add the row's number in its group, from 1."""
    return running(df, by, order, {name: ("count", F.lit(1))})


def whole(df: DataFrame) -> DataFrame:
    """Without the chunk number."""
    return df.drop(CHUNK)
