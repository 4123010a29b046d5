"""Links between alike members of buckets, without pairs as rows.

A bucket holds what shares a band. Its smallest member is the hub, and each
other member is compared with it (distinct pairs of a hub and a member, once
however many buckets they share). Members unlike their hub are then compared
with the whole bucket, in cells of bounded size. So every alike pair of every
bucket ends up connected, and pairs that merely share a band connect nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import join_hot, materialise

#: Members in a slice of a large bucket.
CELL = 1024
#: Given one sketch and many: which of them are alike.
Alike = Callable[[bytes, list[bytes]], np.ndarray]


def roots_of(n: int, links: Iterator[tuple[int, np.ndarray]]) -> list[int]:
    """The smallest linked number of each of ``n`` numbers, by union of (i, partners)."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, partners in links:
        for j in partners.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def _stars(alike: Alike):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = [bool(alike(x, [y])[0]) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
            yield pa.RecordBatch.from_pydict({"hub": b.column("hub"), "node": b.column("node"), "met": pa.array(met, pa.bool_())})

    return run


def _cells(alike: Alike):
    """Rows sorted by cell; emits each member that some link reaches with its root there."""

    def work(rows: list[tuple]) -> pa.RecordBatch | None:
        nodes = sorted({r[3] for r in rows})
        number = {k: i for i, k in enumerate(nodes)}
        sketches = {number[r[3]]: r[5] for r in rows}
        every = sorted({number[r[3]] for r in rows if not r[4]})
        wide = [sketches[i] for i in every]
        at = np.asarray(every)
        lone = sorted({number[r[3]] for r in rows if r[4]})
        roots = roots_of(len(nodes), ((i, at[alike(sketches[i], wide)]) for i in lone if wide))
        moved = [k for k, r in enumerate(roots) if r != k]
        if not moved:
            return None
        return pa.RecordBatch.from_pydict({"u": pa.array([nodes[roots[k]] for k in moved], pa.int64()), "v": pa.array([nodes[k] for k in moved], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "cell_i", "cell_j", "node", "lone", "sketch"))):
                if held and held[0][:3] != row[:3]:
                    if (out := work(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := work(held)) is not None:
            yield out

    return run


def bucket_links(keyed: DataFrame, sketches: DataFrame, alike: Alike, name: str) -> DataFrame:
    """Edges (u, v) that connect all alike pairs of each bucket.

    ``keyed`` (key, node) lists a node once per bucket, ``sketches`` (node,
    sketch) holds each node once. Rows are written per shared bucket, not per
    pair; a bucket of m members with l unlike its hub moves
    m * ceil(l / CELL) + l * ceil(m / CELL) sketches.
    """
    spark = keyed.sparkSession
    shared = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = materialise(shared, f"{name}-shared")
    members = materialise(join_hot(keyed, shared, "key", "node", sizes=shared), f"{name}-members")
    pairs = members.filter("node <> hub").select("hub", "node").distinct()
    with_node = pairs.join(sketches.withColumnRenamed("sketch", "b"), "node")
    both = join_hot(materialise(with_node, f"{name}-pairs"), sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("a")), "hub", "node")
    stars = materialise(both.mapInArrow(_stars(alike), "hub long, node long, met boolean"), f"{name}-stars")
    tied = stars.filter("met").select(F.col("hub").alias("u"), F.col("node").alias("v"))

    # Members unlike their hub, in buckets that hold more than the two.
    unlike = members.filter("m > 2 and node <> hub").join(stars.filter("not met").select("hub", "node"), ["hub", "node"]).select("key", "node")
    unlike = materialise(unlike, f"{name}-unlike")
    wide = unlike.groupBy("key").agg(F.count(F.lit(1)).alias("l"))
    rest = join_hot(members.select("key", "node", "hub", "m"), wide, "key", "node", sizes=shared).filter("node <> hub")
    rest = rest.join(unlike.withColumn("lone", F.lit(True)), ["key", "node"], "left")
    rest = rest.select("key", "node", F.coalesce("lone", F.lit(False)).alias("lone"), F.ceil(F.col("l") / CELL).cast("int").alias("ls"), F.ceil(F.col("m") / CELL).cast("int").alias("ms"))
    slice_of = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = F.transform(span("ls"), lambda i: F.struct(i.alias("cell_i"), slice_of("m", "ms").alias("cell_j"), F.lit(False).alias("lone")))
    rows = F.transform(span("ms"), lambda j: F.struct(slice_of("l", "ls").alias("cell_i"), j.alias("cell_j"), F.lit(True).alias("lone")))
    places = F.concat(columns, F.when(F.col("lone"), rows).otherwise(F.array().cast("array<struct<cell_i:int,cell_j:int,lone:boolean>>")))
    celled = rest.join(sketches, "node").select("key", "node", "sketch", F.explode(places).alias("p")).select("key", "p.cell_i", "p.cell_j", "p.lone", "node", "sketch")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = celled.repartition(parts, "key", "cell_i", "cell_j").sortWithinPartitions("key", "cell_i", "cell_j", "node")
    return tied.unionByName(dealt.mapInArrow(_cells(alike), "u long, v long"))
