"""Tables in the folder that all executors share, where lineage is cut."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="wickflow-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file until it ends
    target = Path(folder) / "wickflow_engine.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def ship_to_driver(spark: SparkSession) -> None:
    """Show the Python workers that Spark starts beside the driver, as keyed state does, where this package is: they get no shipped files."""
    environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([here, *paths])


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, or under the context's checkpoint folder.

    Only a local master may do without either: a temporary folder of one machine
    would scatter the tables of a cluster over its executors' disks.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own.get(app)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wickflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = _own[app] = f"file://{folder}"
    return f"{re.sub('^file:/(?!/)', 'file:///', base.rstrip('/'))}/wickflow-{app}"


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's tables; results that still read them end with it."""
    fs, path = pafs.FileSystem.from_uri(scratch_root(spark))
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write and reread ``df``, so that plans which use it twice compute it once."""
    path = scratch_uri(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
