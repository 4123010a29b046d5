"""Best-fit packing by hierarchical residual rounds.

Documents become token pieces: only those longer than a sequence are cut. Full
pieces are sequences of their own. The rest is packed best-fit within each
partition; bins that are nearly full are emitted, and underfull bins become
items, whole, for the next round with fewer partitions, until one task holds
what is left. Piece rows never move again after the first round: each round
only maps bins to bins and offsets, and a final join adds the offsets up.

Defined results: null text counts as empty, which is one piece holding the end
id alone; repeated rows are packed once each; an empty input gives an empty
output; ties in length go by id and piece. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import materialise, ship, text_of
from wickflow.llm.tokens import crc32_u4, default_tokenizer, encoder

SEQUENCE = 4096
END_ID = 1
#: Bins at least this full leave the hierarchy.
NEARLY_FULL = 0.998
#: Items a packing task aims at.
TASK_ITEMS = 100_000


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin of each item, its offset, fill of each bin).

    ``free`` has a bit for each free capacity that some open bin has, so the
    tightest bin that fits is the lowest set bit from the item's length on.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bin_of, offset, fill = [0] * len(lengths), [0] * len(lengths), []
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i in order:
        n = lengths[i]
        fitting = free >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_by[room].pop()
            if not open_by[room]:
                free &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            open_by[left].append(b)
            free |= 1 << left
    return bin_of, offset, fill


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(enc.encode(text.as_py()), enc.dtype.type(end_id))
                rows += [(doc, k, s, len(p), crc32_u4(p)) for k, s in enumerate(range(0, len(ids), capacity)) for p in (ids[s:s + capacity],)]
            if rows:
                names, types = ("doc_id", "piece", "start", "length", "ids_crc32"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _round(level: int, capacity: int):
    """Pack one partition of items (item, length); ids of new bins are unique across rounds and tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [(b.column("item").to_numpy(), b.column("length").to_numpy()) for b in batches]
        if not parts:
            return
        items, lengths = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((items, -lengths))  # the same in a retried task
        items, lengths = items[order], lengths[order]
        bin_of, offset, fill = best_fit(lengths.tolist(), capacity)
        first = (level << 58) | (TaskContext.get().partitionId() << 32)
        at = np.asarray(bin_of, np.int64)
        for s in range(0, len(items), 50_000):
            cut = slice(s, s + 50_000)
            yield pa.RecordBatch.from_pydict({"item": items[cut], "bin": first + at[cut], "offset": np.asarray(offset[cut], np.int64), "fill": np.asarray(fill, np.int64)[at[cut]]})

    return run


_ROUND_SCHEMA = "item long, bin long, offset long, fill long"


def assign(items: DataFrame, capacity: int) -> DataFrame:
    """(item, sequence_id, offset) for items (item, length), lengths below capacity.

    A round's bins below ``NEARLY_FULL`` that could still take the smallest of
    them are the next round's items. Partitions hold about ``TASK_ITEMS`` items,
    so no task grows with the input; rounds end with one task, or when a round
    joins hardly any bins.
    """
    level, maps = 0, []
    left, n = items, items.count()
    while n:
        level += 1
        parts = -(-n // TASK_ITEMS)
        if level == 1:
            parts = max(parts, min(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096)))
        dealt = left.repartition(parts, F.xxhash64(F.lit(level), "item"))
        done = materialise(dealt.mapInArrow(_round(level, capacity), _ROUND_SCHEMA), f"pack-round{level}")
        maps.append(done)
        if parts == 1:
            break
        bins = done.groupBy("bin").agg(F.first("fill").alias("length")).filter(F.col("length") < int(capacity * NEARLY_FULL))
        bins = materialise(bins.select(F.col("bin").alias("item"), "length"), f"pack-bins{level}")
        low, before = bins.agg(F.min("length").alias("m"), F.count(F.lit(1)).alias("c")).first(), n
        left = bins.filter(F.col("length") + F.lit(low["m"] or 0) <= capacity)
        n = left.count()
        if n < 2 or level > 2 and n > 0.98 * before:
            break
    if not maps:
        return items.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    at = maps[0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for m in maps[1:]:
        moved = m.select(F.col("item").alias("sequence_id"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        at = at.join(moved, "sequence_id", "left").select(
            "item", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return at


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and offset there."""
    pieces = pieces_of(docs, tokenizer or default_tokenizer(), end_id, capacity, id_col, text_col)
    numbered = materialise(pieces.withColumn("item", F.monotonically_increasing_id()), "pack-items")
    small = assign(numbered.filter(F.col("length") < capacity).select("item", "length"), capacity)
    whole = numbered.filter(F.col("length") >= capacity).withColumn("sequence_id", -F.col("item") - 1).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return numbered.filter(F.col("length") < capacity).join(small, "item").select(*columns).unionByName(whole.select(*columns))
