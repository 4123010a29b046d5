"""Paged candle history as a Spark data source, in batches or followed as a stream.

An exchange's history is a folder of pages, ``page-<first ts>.json``, each an
array of ``[ts, o, h, l, c, v]``. Several folders are given in order of trust. A
page comes from the first folder that has it whole; where it is missing, broken or
has gaps, the later folders supply what lacks, candle by candle. Reading resumes
after ``since`` and stops before the last two candles of ``now``, which may still
change. Pages are dealt out to tasks; the driver lists names only. As a stream the
offset is the first time stamp not yet read, kept in the checkpoint.

    spark.dataSource.register(CandlePages)
    spark.read.format("candle_pages").option("roots", "s3://a,s3://b").option("timeframe", "1h").load()
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from wickflow.schemas import SERIES, TIMEFRAME_MS

_PAGE = re.compile(r"page-(\d+)\.json")
_COLUMNS = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Page:
    """Candles from ``first`` up to before ``end``, and the files that may have them, in order."""

    first: int
    end: int
    files: tuple[str, ...]


class Pages(InputPartition):
    def __init__(self, pages: list[Page]) -> None:
        self.pages = pages


def _rows(file: str) -> dict[int, tuple]:
    """Candles of a file by time; none if it can't be read."""
    try:
        fs, path = pafs.FileSystem.from_uri(file)
        with fs.open_input_stream(path) as f:
            return {int(r[0]): tuple(float(x) for x in r[1:6]) for r in json.loads(f.read()) if len(r) >= 6}
    except (OSError, ValueError, TypeError):
        return {}


def page_rows(page: Page, step: int) -> Iterator[tuple[int, tuple]]:
    """The page's candles from the first files that have them; later ones are opened while some lack."""
    found: dict[int, tuple] = {}
    want = (page.end - page.first) // step
    for file in page.files:
        found = {t: r for t, r in _rows(file).items() if page.first <= t < page.end} | found
        if len(found) >= want:
            break
    return iter(sorted(found.items()))


class _Options:
    def __init__(self, options: dict) -> None:
        self.roots = [r.strip().rstrip("/") for r in options["roots"].split(",")]
        self.timeframe, self.pair, self.bot = options.get("timeframe", "1h"), options.get("pair", ""), options.get("bot_id", "dev-bot")
        self.step = TIMEFRAME_MS[self.timeframe]
        self.since = int(options.get("since", 0))
        self.now = options.get("now")
        self.per_task = int(options.get("pagespertask", 16))

    def limit(self) -> int:
        """Candles from here on may still change: the last closed one and the open one."""
        now = int(self.now) if self.now is not None else int(time.time() * 1000)
        return now // self.step * self.step - self.step

    def listed(self) -> dict[int, list[str]]:
        """First time stamp to files, in the order of the folders; a folder that can't be listed is passed over."""
        found: dict[int, list[str]] = {}
        for root in self.roots:
            try:
                fs, path = pafs.FileSystem.from_uri(root)
                names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(path))]
            except OSError:
                continue
            for name in names:
                if m := _PAGE.fullmatch(name):
                    found.setdefault(int(m[1]), []).append(f"{root}/{name}")
        return found

    def pages(self, start: int, end: int) -> list[Page]:
        """Pages with candles from ``start`` up to before ``end``. One ends where the next of any folder begins; its files are those that begin in it or last before it."""
        listed = self.listed()
        starts = sorted(listed)
        out, latest = [], {}
        for k, first in enumerate(starts):
            # A folder with other page limits holds these candles in its page before.
            latest |= {f.rsplit("/", 1)[0]: f for f in listed[first]}
            stop = starts[k + 1] if k + 1 < len(starts) else end
            lo, hi = max(first, start), min(stop, end)
            if lo < hi:
                out.append(Page(lo, hi, tuple(latest[root] for root in self.roots if root in latest)))
        return out

    def dealt(self, start: int, end: int) -> list[Pages]:
        pages = self.pages(start, end)
        return [Pages(pages[i:i + self.per_task]) for i in range(0, len(pages), self.per_task)] or [Pages([])]

    def batches(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for page in partition.pages:
            rows = list(page_rows(page, self.step))
            if rows:
                n = len(rows)
                cols = [pa.array([x] * n, pa.string()) for x in (self.bot, self.pair, self.timeframe)] + [pa.array([t for t, _ in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([r[i] for _, r in rows], pa.float64()) for i in range(5))], names=[*SERIES, "ts", *_COLUMNS])


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = _Options(options)

    def partitions(self) -> list[Pages]:
        return self.options.dealt(self.options.since, self.options.limit())

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.options.batches(partition)


class _StreamReader(DataSourceStreamReader):
    """Follow mode: each batch takes what has become final since the last."""

    def __init__(self, options: dict) -> None:
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {"next": self.options.since}

    def latestOffset(self) -> dict:
        """Up to the last page's end as far as it is known: the newest page is read to see its last candle."""
        listed = self.options.listed()
        if not listed:
            return {"next": self.options.since}
        newest = [t for f in listed[max(listed)] for t in _rows(f)]
        return {"next": max(self.options.since, min(self.options.limit(), max(newest, default=max(listed) - self.options.step) + self.options.step))}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.options.dealt(start["next"], end["next"])

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return self.options.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class CandlePages(DataSource):
    """Options: roots (comma-separated, in order of trust), timeframe, pair, bot_id, since, now (both milliseconds), pagespertask."""

    @classmethod
    def name(cls) -> str:
        return "candle_pages"

    def schema(self) -> str:
        return "bot_id string, pair string, timeframe string, ts bigint, open double, high double, low double, close double, volume double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def write_pages(candles: DataFrame, root: str, rows: int = 1000) -> None:
    """Candles of one series as pages of up to ``rows`` time steps each, written by the tasks that hold them."""
    step = TIMEFRAME_MS[candles.select("timeframe").first()[0]]
    numbered = candles.select("ts", F.array(*[F.col(c).cast("double") for c in ("ts", *_COLUMNS)]).alias("r"), (F.floor(F.col("ts") / (step * rows)) * step * rows).alias("first"))
    # A page's rows are bounded by its length.
    pages = numbered.groupBy("first").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ts", "r"))), lambda x: x["r"])).alias("body"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        fs.create_dir(path, recursive=True)
        for b in batches:
            for first, body in zip(b.column("first").to_pylist(), b.column("body").to_pylist()):
                with fs.open_output_stream(f"{path}/page-{first}.json") as f:
                    f.write(body.encode())
            yield pa.RecordBatch.from_pydict({"first": b.column("first")})

    pages.mapInArrow(put, "first long").write.format("noop").mode("overwrite").save()
