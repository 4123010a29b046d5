"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickflow.scratch import materialise, scratch_uri, ship

__all__ = ["BROADCAST_ROWS", "SPACE", "SPACE_CHARS", "join_dimension", "join_hot", "joined_spans", "materialise", "scratch_uri", "ship", "single_threaded", "table", "text_of"]

#: The characters that separate words, as a Java/Python character class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null taken as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_spans(parts: list[tuple[int, int, str, int]]) -> str:
    """``kind:start:end`` by start, then kind order, comma-joined.

    Items are (start, kind order, kind, end).
    """
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(parts))


#: Most rows of a side that may be broadcast; such sides are counted first.
BROADCAST_ROWS = 100_000


def join_dimension(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a materialised per-group table: broadcast when its counted size
    allows it, else a shuffled join whose hot keys AQE splits."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return left.join(right, on, how)


#: A key below this many rows is never salted; at most HOT_KEYS are, each over SALTS parts.
HOT_ROWS, HOT_KEYS, SALTS = 2_000, 200, 64


def join_hot(rows: DataFrame, table: DataFrame, on: str, by: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """Join with a table of one row per key, keys that hold very many rows spread.

    The largest keys are counted first (pre-aggregated); their rows are salted by
    a hash of ``by`` and their row of the table is repeated for each salt. A key
    beyond the first ``HOT_KEYS`` holds less than one row in that many. Where the
    counts are known they come as ``sizes`` (key, m).
    """
    counted = rows.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("c")) if sizes is None else sizes.select(on, F.col("m").alias("c"))
    counts = counted.filter(F.col("c") > HOT_ROWS)
    hot = [r[0] for r in counts.orderBy(F.desc("c")).limit(HOT_KEYS).select(on).collect()]
    if not hot:
        return rows.join(table, on, how)
    is_hot = F.col(on).isin(hot)
    salted = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(F.lit("salt"), by), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = table.withColumn("__salt", F.explode(salts))
    return salted.join(spread, [on, "__salt"], how).drop("__salt")


def single_threaded() -> None:
    """In a Python worker: one thread for each task, as Spark schedules them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
