"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Every text becomes the set of its 5-word n-grams; a shorter text is one
   n-gram of all its words. One pass writes a 128-bit digest of the set, its
   size and its band hashes to a table.
2. Equal sets are one class with a count: copies are never paired.
3. Classes that share a band hash are compared by sketches, one byte of each
   MinHash (see ``buckets``); components of what is alike by these are blocks.
   ``sketch_cut`` asks for so little that hardly any true pair is lost.
4. Each block's texts are read again and verified exactly: an inverted index
   of the block gives the full intersection size of every pair in it. Blocks
   over ``CELL`` classes or ``CELL_GRAMS`` n-grams are cut into cells, pairs of
   slices, so that no task holds more than two slices; pairs are counted where
   they meet and never become rows.
5. Verified links' components are the near-duplicate classes.

``choose_bands`` picks band and row counts for the target recall at the
threshold. Blocks are supersets of the candidates, so recall is at least that,
less ``SKETCH_LOSS``.

Defined results: texts without words (null and empty ones too) have no n-grams
and link to nothing, each a class with the other empty ones of n_links 0;
repeated rows count as copies of each other; a class's id is its smallest
doc_id, null only if all are; an empty input gives an empty output. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickflow.llm.buckets import bucket_links, roots_of
from wickflow.llm.common import join_hot, materialise, ship, text_of
from wickflow.llm.components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Most hash functions a signature may use.
MAX_HASHES = 192
#: Classes and n-grams in a slice of a large block.
CELL, CELL_GRAMS = 1024, 1 << 20
#: Share of pairs at the threshold that sketches may lose.
SKETCH_LOSS = 1e-5
_SEED = 20_240_607
_MASK = 2**64 - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which bands enough for the
    recall at the threshold stay within the number of hashes."""
    best = (1, 1)
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - p)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    """Powers of the base modulo 2^64, at least ``n`` of them."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_inverses = np.ones(1, np.uint64)


def _inverse(n: int) -> np.ndarray:
    """Powers of the base's inverse modulo 2^64."""
    global _inverses
    if len(_inverses) < n:
        more = np.full(max(n, 2 * len(_inverses)), pow(_BASE, -1, 2**64), np.uint64)
        more[0] = 1
        _inverses = np.multiply.accumulate(more)
    return _inverses[:n]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, from one pass over its bytes.

    A word's hash is a polynomial in its mixed bytes: the difference of two
    prefix sums, scaled by an inverse power so that it doesn't depend on the place.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _power(len(raw) + 1), _inverse(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngrams(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; one of all words if fewer than ``n``."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = w[:len(w) - k + 1].copy()
    for i in range(1, k):
        h = _mix(h * np.uint64(_BASE) + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def _coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return (rng.integers(0, 2**32, hashes, np.uint64).astype(np.uint32) | np.uint32(1)), rng.integers(0, 2**32, hashes, np.uint64).astype(np.uint32)


def min_hashes(grams: np.ndarray, hashes: int) -> np.ndarray:
    a, b = _coefficients(hashes)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(hashes, 2**32 - 1, np.uint32)
    for s in range(0, len(low), 2048):
        np.minimum(best, (low[s:s + 2048, None] * a + b).min(axis=0), out=best)
    return best


def sketch_cut(hashes: int, threshold: float, loss: float = SKETCH_LOSS) -> int:
    """The most bytes that sketches must share for a pair at the threshold to be lost with a probability up to ``loss``."""
    p = threshold + (1 - threshold) / 256
    lost = 0.0
    for k in range(hashes + 1):
        lost += comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
        if lost > loss:
            return k
    return hashes


def alike_sketches(cut: int):
    """One sketch against many: those that share at least ``cut`` bytes."""

    def alike(one: bytes, many: list[bytes]) -> np.ndarray:
        table = np.frombuffer(b"".join(many), np.uint8).reshape(len(many), -1)
        return (table == np.frombuffer(one, np.uint8)).sum(axis=1) >= cut

    return alike


def band_hashes(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the set's MinHash signature."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_BASE)
    for r in best.reshape(bands, rows).T.astype(np.uint64):
        key = _mix(key * np.uint64(_BASE) + r)
    return key.view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, size, keys, sketch = [], [], [], []
            for text in b.column("text").to_pylist():
                g = ngrams(text)
                digest.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
                size.append(len(g))
                best = min_hashes(g, bands * rows) if len(g) else None
                keys.append(np.empty(0, np.int64) if best is None else band_hashes(best, bands, rows))
                sketch.append(b"" if best is None else best.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "digest": pa.array(digest, pa.binary()),
                                              "n_grams": pa.array(size, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary())})

    return run


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, a 64-bit key of the text, digest and size of its n-gram set, band hashes, sketch."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_key"), text_of(docs).alias("text"))
    return keyed.mapInArrow(_sign(bands, rows), "doc_id long, text_key long, digest binary, n_grams long, bands array<long>, sketch binary")


def pair_links(sets: list[np.ndarray], slice_of: np.ndarray, across: bool, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, partners j > i) of all pairs at or above the threshold.

    ``across`` counts only pairs of different slices. The inverted index lists,
    for each n-gram, the sets that hold it; adding up the lists of one set's
    n-grams gives its intersection with every other set at once.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.lexsort((owner, flat))
    values, by = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    ends = np.append(starts[1:], len(values))
    number = np.empty(len(flat), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), ends - starts)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(sets)):
        grams = number[begin[i]:begin[i + 1]]
        shared = grams[ends[grams] - starts[grams] > 1]
        if not len(shared):
            continue
        counts = np.zeros(len(sets), np.int64)
        for lo in range(0, len(shared), 4096):  # lists are added a part at a time
            part = shared[lo:lo + 4096]
            counts += np.bincount(np.concatenate([by[s:e] for s, e in zip(starts[part], ends[part])]), minlength=len(sets))
        near = counts >= threshold * (sizes[i] + sizes - counts) - 1e-9
        near[:i + 1] = False
        if across:
            near &= slice_of != slice_of[i]
        if near.any():
            yield i, np.flatnonzero(near)


def _verify(threshold: float):
    """Rows sorted by cell; emits per class its links within the cell and its root there."""

    def work(rows: list[tuple]) -> pa.RecordBatch | None:
        across = rows[0][1] != rows[0][2]
        nodes, copies = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        sets = [ngrams(r[6]) for r in rows]
        links = np.zeros(len(rows), np.int64)

        def counted() -> Iterator[tuple[int, np.ndarray]]:
            for i, near in pair_links(sets, np.array([r[5] for r in rows]), across, threshold):
                links[i] += copies[near].sum()
                links[near] += copies[i]
                yield i, near

        roots = np.array(roots_of(len(rows), counted()))
        got = np.flatnonzero(links)
        if not len(got):
            return None
        return pa.RecordBatch.from_pydict({"node": nodes[got], "links": links[got], "root": nodes[roots[got]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("block", "cell_i", "cell_j", "node", "copies", "slice", "text"))):
                if held and held[0][:3] != row[:3]:
                    if len(held) > 1 and (out := work(held)) is not None:
                        yield out
                    held = []
                if not held or held[-1][3] != row[3]:  # repeated rows of a representative
                    held.append(row)
        if len(held) > 1 and (out := work(held)) is not None:
            yield out

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, text_key, class_id, copy_id, n_links.

    ``class_id`` is the smallest doc_id of the near-duplicate class, ``copy_id``
    that among rows with an equal n-gram set, and ``n_links`` the number of
    other rows at or above the threshold, copies included.
    """
    spark = docs.sparkSession
    ship(spark)
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    signed = materialise(signatures(docs, bands, rows), "jaccard-signatures")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_key").alias("k"))
    classes = signed.groupBy("digest").agg(F.min(first).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")

    keyed = classes.filter("n_grams > 0").select("node", F.explode("bands").alias("key"))
    cut = sketch_cut(bands * rows, threshold)
    edges = bucket_links(keyed, classes.select("node", "sketch"), alike_sketches(cut), "jaccard-buckets")
    blocks = components(edges, "jaccard-blocks").withColumnRenamed("root", "block")

    sized = materialise(blocks.join(classes.select("node", "rep", "copies", "n_grams"), "node"), "jaccard-sized")
    slices = F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum("n_grams") / CELL_GRAMS)).cast("int")
    member = join_hot(sized, sized.groupBy("block").agg(slices.alias("slices")), "block", "node")
    member = member.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    member = materialise(member.select("node", "block", "slice", "slices", "copies", F.col("rep.id").alias("r_id"), F.col("rep.k").alias("r_key")), "jaccard-members")
    # Every pair of slices is one cell; a class goes to the cells of its slice.
    others = F.sequence(F.lit(0), F.col("slices") - 1)
    # The members grow with the corpus, so they are never broadcast.
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(member.hint("merge"), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")))
    celled = texts.select("block", "node", "copies", "slice", "text", F.explode(others).alias("other"))
    celled = celled.select("block", F.least("slice", "other").alias("cell_i"), F.greatest("slice", "other").alias("cell_j"), "node", "copies", "slice", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = celled.repartition(parts, "block", "cell_i", "cell_j").sortWithinPartitions("block", "cell_i", "cell_j", "node")
    verified = materialise(dealt.mapInArrow(_verify(threshold), "node long, links long, root long"), "jaccard-links")

    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(verified.filter("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")), "jaccard-classes-of")
    named = classes.drop("bands", "sketch").join(linked, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named, "jaccard-named")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    full = join_hot(named, least, "root", "node").select(
        "digest", F.col("least").alias("class_rep"), F.col("rep").alias("copy_rep"),
        F.when(F.col("n_grams") > 0, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    full = materialise(full, "jaccard-result")
    return join_hot(signed.select("doc_id", "text_key", "digest", "n_grams"), full, "digest", "doc_id").select(
        "doc_id", "text_key", F.col("class_rep.id").alias("class_id"), F.col("copy_rep.id").alias("copy_id"), "n_links",
        F.col("class_rep.k").alias("class_key"), "n_grams")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one row of each near-duplicate class: that of its smallest id.

    Rows without n-grams (null, empty and wordless texts) are left alone,
    repeated or not. Of equal rows with the kept id and text one stays. Columns
    keep their names and values, whatever these are; an empty input gives an
    empty output.
    """
    fates = materialise(jaccard_join(docs, threshold), "jaccard-fates")
    id_of = lambda c: (F.coalesce(c, F.lit(0)).alias("k_id"), c.isNull().alias("k_null"))
    own = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    marks = fates.filter("n_grams > 0").groupBy(*id_of(F.col("doc_id")), F.col("text_key").alias("k_text")).agg(
        F.first(own).alias("own"), F.count(F.lit(1)).alias("rows")).filter("not own or rows > 1").select("k_id", "k_null", "k_text", "own")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *id_of(F.col("doc_id").cast("long")), F.xxhash64(text_of(docs)).alias("k_text"))
    # Like the members, this list grows with the corpus and isn't broadcast; rows of a key are numbered where the join left them.
    keys = ["k_id", "k_null", "k_text"]
    met = keyed.join(marks.hint("merge"), keys, "left")
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    return met.filter(F.col("own").isNull() | F.col("own") & (F.col("nth") == 1)).select("row.*")


def jaccard_sql(threshold: float = THRESHOLD, n: int = N) -> str:
    """The same classes and link counts by an exact join, for DuckDB over ``documents``."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END)) AS g FROM words),
classes AS (SELECT g, min(doc_id) AS rep, count(*) AS copies, len(g) AS n, row_number() OVER () AS k FROM sets GROUP BY g),
grams AS (SELECT k, unnest(g) AS x FROM classes),
met AS (SELECT a.k AS ka, b.k AS kb, count(*) AS shared FROM grams a JOIN grams b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2),
links AS (SELECT ka, kb, b.copies FROM met JOIN classes a ON a.k = ka JOIN classes b ON b.k = kb WHERE shared >= {threshold} * (a.n + b.n - shared) - 1e-9),
reach AS (SELECT k, k AS r FROM classes UNION SELECT l.kb AS k, r FROM reach JOIN links l ON l.ka = reach.k),
least AS (SELECT reach.k, min(c.rep) AS class_id FROM reach JOIN classes c ON c.k = reach.r GROUP BY reach.k),
counted AS (SELECT ka AS k, sum(copies) AS others FROM links GROUP BY ka)
SELECT s.doc_id, e.class_id, c.rep AS copy_id, CAST(CASE WHEN c.n > 0 THEN c.copies - 1 + coalesce(others, 0) ELSE 0 END AS BIGINT) AS n_links
FROM sets s JOIN classes c ON c.g = s.g JOIN least e USING (k) LEFT JOIN counted USING (k)
"""
