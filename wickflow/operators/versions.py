"""A store that is merged when it is read: deltas by version, a compacted base, day partitions.

A write adds one folder per version and replaces it if it is written again, so a
stream's replayed batch changes nothing. A read merges the base and the deltas
after it by the store's own rule. Compaction writes a new base; it counts once
its marker stands, so a broken one is ignored. Rows lie in day partitions: a read
of some days lists only those, and retention drops whole days by their folders
and rewrites only days from which something is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickflow.operators import memory
from wickflow.operators.store import env_of
from wickflow.schemas import DAY_MS, SERIES
from wickflow.scratch import materialise

Merge = Callable[[DataFrame], DataFrame]
DAY, VERSION = "day", "version"


def latest_candles(rows: DataFrame) -> DataFrame:
    """Of each candle the last version; ``env`` stays what it was at first."""
    key = [*SERIES, "ts"]
    rest = [c for c in rows.columns if c not in (*key, "env", VERSION, DAY)]
    found = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), VERSION).alias("x"), F.min_by("env", VERSION).alias("env"))
    return found.select(*key, "x.*", "env")


def summed_memory(rows: DataFrame) -> DataFrame:
    """Pattern memory of all versions: counts added, rates of the sums."""
    return memory.total(rows)


@dataclass(frozen=True)
class VersionStore:
    """Rows of ``schema`` under ``root``, merged by ``merge``; ``at`` (milliseconds) gives the day."""

    root: str
    schema: str
    merge: Merge = latest_candles
    at: str = "ts"

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _versions(self, spark: SparkSession, kind: str) -> list[int]:
        fs, path = self._fs(spark, f"{self.root}/{kind}")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n.removeprefix("v=")) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{n}/_SUCCESS"))]
        return sorted(done)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.withColumn(DAY, F.floor(F.col(self.at) / DAY_MS)).write.mode("overwrite").partitionBy(DAY).parquet(path)

    def write(self, rows: DataFrame, version: int) -> None:
        """The rows of one version, 0 or more; a repeat replaces them. Fits ``foreachBatch``."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        made = rows.withColumn("env", env_of(F.col("bot_id"))) if "env" in names and "env" not in rows.columns else rows
        self._write(made.select(*names), f"{self.root}/delta/v={version}")

    def _rows(self, spark: SparkSession) -> DataFrame | None:
        base = (self._versions(spark, "base") or [-1])[-1]
        parts = [(f"{self.root}/base/v={base}", base)] * (base >= 0) + [(f"{self.root}/delta/v={v}", v) for v in self._versions(spark, "delta") if v > base]
        found = None
        for path, v in parts:
            rows = spark.read.schema(f"{self.schema}, {DAY} bigint").option("basePath", path).parquet(path).withColumn(VERSION, F.lit(v).cast("long"))
            found = rows if found is None else found.unionByName(rows)
        return found

    def read(self, spark: SparkSession, first_day: int | None = None) -> DataFrame:
        """The merged rows; with ``first_day`` only folders from that day on are listed."""
        rows = self._rows(spark)
        if rows is None:
            return spark.createDataFrame([], self.schema)
        rows = rows if first_day is None else rows.filter(F.col(DAY) >= first_day)
        return self.merge(rows).select(*[c.split()[0] for c in self.schema.split(", ")])

    def compact(self, spark: SparkSession) -> int:
        """Merge all versions into a new base; returns its version. Older folders stay until ``vacuum``."""
        last = max([*self._versions(spark, "base"), *self._versions(spark, "delta")], default=-1)
        if last >= 0 and last not in self._versions(spark, "base"):
            self._write(self.read(spark), f"{self.root}/base/v={last}")
        return last

    def vacuum(self, spark: SparkSession) -> None:
        """Delete what no read needs any more."""
        base = (self._versions(spark, "base") or [-1])[-1]
        for kind, last in (("delta", base), ("base", base - 1)):
            for v in self._versions(spark, kind):
                if v <= last:
                    fs, path = self._fs(spark, f"{self.root}/{kind}/v={v}")
                    fs.delete(path, True)


def expire_days(spark: SparkSession, root: str, now: int, keep_days: int, referenced: DataFrame | None = None, key: str = "candle_id", at: str = "ts") -> dict[str, int]:
    """Retention of a table in day partitions: how many days were dropped, rewritten, left alone.

    Days before ``now - keep_days`` go by their folders. Only days of which
    rows stay, since they are ``referenced`` by key or since the limit falls into
    the day, are rewritten, each as one partition; all others keep their files.
    """
    cut = now - keep_days * DAY_MS
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted(int(n.removeprefix(f"{DAY}=")) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith(f"{DAY}="))
    old = [d for d in days if d * DAY_MS < cut]
    if not old:
        return {"dropped": 0, "rewritten": 0, "untouched": len(days)}
    table = spark.read.parquet(root).filter(F.col(DAY) <= old[-1])
    stays = table.filter(F.col(at) >= cut)
    if referenced is not None:
        stays = stays.unionByName(table.filter(F.col(at) < cut).join(referenced.select(key).distinct(), key, "left_semi").select(*table.columns))
    stays = materialise(stays, "retained")
    rewritten = {r[0] for r in stays.select(DAY).distinct().collect()}  # at most the days that are old
    if rewritten:
        stays.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(root)
    for d in old:
        if d not in rewritten:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{DAY}={d}"), True)
    return {"dropped": len(old) - len(rewritten), "rewritten": len(rewritten), "untouched": len(days) - len(old)}
