"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text character by character: at each step the
current character is written out, and a shared random bit of (step, character)
says whether to move on. Texts a few edits apart fall back into the same walk,
so edit distance becomes Hamming distance of what is written. One walk reads a
whole text of any length to its end, so a shift is found again once. Texts are
walked side by side; the longest, once few are left, one after the other.

The fingerprint samples the written string at shared steps: one step in each
block of 2^level steps, chosen so that coarser samples are subsets of finer
ones and texts of different length stay comparable. Each sample is one hex
digit (0 past the end). ``near_duplicates`` bands sampled digits at a
fingerprint's own level and at coarser ones, compares what shares a band on
whole fingerprints (see ``buckets``) and counts the links in the components of
what is alike, every pair once, large ones in cells.

Defined results: null text counts as empty, and two empty texts have likeness
1; equal texts have equal fingerprints; repeated ids are ordered by a hash of their text;
an empty input gives an empty output. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.llm.buckets import bucket_links, roots_of
from wickflow.llm.common import join_hot, materialise, ship, text_of
from wickflow.llm.components import components
from wickflow.llm.ranges import byte_ranges

#: Blocks of a fingerprint: more than half of this, up to this, once a text is long enough.
SAMPLES = 512
#: Characters are told apart by this many classes, and random bits repeat after PERIOD steps.
CLASSES, PERIOD = 256, 1024
SEED = 0x5DEECE66D
#: Characters walked at once (or one text), and the fewest texts walked side by side.
CHARS, MIN_LANES = 1 << 22, 48
#: Classes in a slice of a large block.
CELL = 1024


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixing function on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + SEED) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=1)
def _waits() -> np.ndarray:
    """waits[step mod PERIOD, class]: steps until the walk moves on, at least 1."""
    at = np.arange(PERIOD * CLASSES, dtype=np.uint64)
    bits = (_mix(at, 1) >> np.uint64(40)).astype(np.uint8).reshape(PERIOD, CLASSES) & 1
    bits[PERIOD - 1] |= (~bits.any(axis=0)).astype(np.uint8)  # every class moves on somewhere
    waits = np.zeros((PERIOD, CLASSES), np.int32)
    ahead = np.full(CLASSES, 0, np.int32)
    for _ in range(2):
        for s in range(PERIOD - 1, -1, -1):
            ahead = np.where(bits[s] == 1, 1, ahead + 1)
            waits[s] = ahead
    return waits.ravel()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def _waits_list() -> list[int]:
    return _waits().tolist()


def _classes(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int32)


def walks(codes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each text, longest first, the step at which each of its characters is left."""
    sizes = np.array([len(c) for c in codes], np.int64)
    lanes = len(codes)
    together = int(sizes[MIN_LANES]) if lanes > MIN_LANES else 0
    # The characters of one step lie side by side; only texts that are that long have one.
    active = np.searchsorted(-sizes, -np.arange(1, together + 1), "right")
    first = np.concatenate([[0], np.cumsum(active)])
    flat, left = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int64)
    for k, c in enumerate(codes):
        n = min(len(c), together)
        flat[first[:n] + k] = _classes(c[:n])
    waits, step = _waits(), np.zeros(lanes, np.int64)
    at = first.tolist()
    for i in range(together):
        now = step[:at[i + 1] - at[i]]
        now += waits[((now & (PERIOD - 1)) << 8) + flat[at[i]:at[i + 1]]]
        left[at[i]:at[i + 1]] = now
    table, last = _waits_list(), PERIOD - 1
    for k, c in enumerate(codes):
        n = min(len(c), together)
        out = np.empty(len(c), np.int64)
        out[:n] = left[first[:n] + k]
        now = int(step[k])
        for s in range(n, len(c), 1 << 16):
            more = _classes(c[s:s + (1 << 16)]).tolist()
            path = accumulate(more, lambda at, c: at + table[((at & last) << 8) + c], initial=now)
            out[s:s + len(more)] = np.fromiter(path, np.int64, len(more) + 1)[1:]
            now = int(out[s + len(more) - 1])
        yield out


def level_of(steps: int) -> int:
    """The level at which a walk of so many steps has at most SAMPLES blocks."""
    level = 0
    while -(-steps >> level) > SAMPLES:
        level += 1
    return level


@lru_cache(maxsize=4096)
def _positions(level: int, blocks: int) -> np.ndarray:
    """The sampled step of each block: one of the two of its halves, by a shared bit."""
    at = np.arange(blocks, dtype=np.int64)
    for k in range(level, 0, -1):
        at = 2 * at + ((_mix(at, 100 + k) >> np.uint64(33)) & np.uint64(1)).astype(np.int64)
    return at


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of texts: ``level:n_chars:digits``."""
    codes = [codes_of(t) for t in texts]
    out = ["0:0:"] * len(texts)
    hexed = np.frombuffer(b"0123456789abcdef", np.uint8)
    order = sorted((k for k in range(len(texts)) if len(codes[k])), key=lambda k: -len(codes[k]))
    s = 0
    while s < len(order):
        e, chars = s + 1, len(codes[order[s]])
        while e < len(order) and chars + len(codes[order[e]]) <= CHARS:
            chars += len(codes[order[e]])
            e += 1
        for k, left in zip(order[s:e], walks([codes[k] for k in order[s:e]])):
            steps = int(left[-1])
            level = level_of(steps)
            at = _positions(level, -(-steps >> level))
            char = np.searchsorted(left, at, "right")
            known = char < len(left)
            code = codes[k][np.where(known, char, 0)].astype(np.uint64)
            value = (_mix((code << np.uint64(20)) ^ at.astype(np.uint64), 7) >> np.uint64(20)) % np.uint64(15) + np.uint64(1)
            out[k] = f"{level}:{len(left)}:{hexed[np.where(known, value, 0).astype(np.uint8)].tobytes().decode()}"
        s = e
    return out


def _at_level(digits: np.ndarray, level: int, to: int, blocks: int) -> np.ndarray:
    """The coarser sample of a finer fingerprint, padded with zeros to ``blocks``."""
    at = _positions(to, blocks) >> level if to else np.arange(blocks)
    # A coarse position is a fine sample of the block that holds it.
    return np.where(at < len(digits), digits[np.minimum(at, max(len(digits) - 1, 0))] if len(digits) else 0, 0)


def likeness(a: str, b: str) -> float:
    """Share of sampled steps at which two fingerprints agree; steps past both ends don't count."""
    if a == b:
        return 1.0
    (la, _, da), (lb, _, db) = (x.split(":") for x in (a, b))
    la, lb = int(la), int(lb)
    xa, xb = (_digits(d) for d in (da, db))
    to = max(la, lb)
    blocks = max(len(xa) if la == to else -(-(len(xa) << la) >> to), len(xb) if lb == to else -(-(len(xb) << lb) >> to))
    if not blocks:
        return 1.0
    xa, xb = _at_level(xa, la, to, blocks), _at_level(xb, lb, to, blocks)
    used = (xa > 0) | (xb > 0)
    return float((xa[used] == xb[used]).mean()) if used.any() else 1.0


def _digits(body: str) -> np.ndarray:
    """The digits as numbers; 0 is past the end."""
    return np.frombuffer(body.encode(), np.uint8) - 48


@lru_cache(maxsize=256)
def _picks(level: int, slots: int) -> np.ndarray:
    """picks[blocks, slot]: the block of least shared hash. It stays the same for most other numbers of blocks,
    so a slot of two fingerprints agrees at least as often as their digits do."""
    at = np.arange(slots * SAMPLES, dtype=np.uint64).reshape(slots, SAMPLES)
    ranks = _mix(at, 500 + level)
    least = np.minimum.accumulate(ranks, axis=1)
    best = np.maximum.accumulate(np.where(ranks == least, np.arange(SAMPLES), 0), axis=1)
    return np.concatenate([np.zeros((1, slots), np.int64), best.T])


def band_keys(fingerprint: str, bands: int = 16, digits: int = 6, coarser: int = 1, least: float = 0) -> list[str]:
    """Bit-sampled bands at a fingerprint's level and ``coarser`` ones: ``level.band.digits``.

    Each band reads ``digits`` sampled blocks, chosen by a shared hash of band and
    level among the blocks that have a digit. Coarser levels with fewer than
    ``least`` such blocks are left out: a text whose own level that is has more
    than half of SAMPLES there, so the two could not be alike.
    """
    own, _, body = fingerprint.split(":")
    own, x = int(own), _digits(body)
    out = []
    for level in range(own, own + coarser + 1):
        y = x if level == own else _at_level(x, own, level, -(-len(x) >> (level - own)))
        n = int(np.count_nonzero(y))
        if n and (level == own or n >= least):
            read = (y[_picks(level, bands * digits)[n]] + 48).astype(np.uint8).tobytes().decode("latin-1")
            out += [f"{level}.{k}.{read[k * digits:(k + 1) * digits]}" for k in range(bands)]
    return out


def shared_bands(a: str, b: str) -> int:
    """Number of bands that two fingerprints share at any level."""
    return len({x.split(".")[1] for x in set(band_keys(a)) & set(band_keys(b))})


def edited_text(text: str, following: str) -> str:
    """The last third replaced by the first as many characters of the next text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and position; each real row is compared with the one after it."""
    held: list[tuple[int, int, str]] = []

    def work(rows: list[tuple[int, int, str]]) -> pa.RecordBatch | None:
        # rows[i + 1] follows rows[i]; border copies (own = 0) are only followed.
        mine = [i for i in range(len(rows) - 1) if rows[i][0]]
        if not mine:
            return None
        texts = [r[2] for r in rows]
        edited = [edited_text(texts[i], texts[i + 1]) for i in mine]
        prints = fingerprints(texts + edited)
        own, changed = prints[:len(texts)], prints[len(texts):]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[i][1] for i in mine], pa.int64()), "n_chars": pa.array([len(texts[i]) for i in mine], pa.int64()),
            "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            "fingerprint": [own[i] for i in mine], "edited_fingerprint": changed,
            "near_edited": [likeness(own[i], c) for i, c in zip(mine, changed)], "near_next": [likeness(own[i], own[i + 1]) for i in mine],
            "shared_bands": pa.array([shared_bands(own[i], c) for i, c in zip(mine, changed)], pa.int64())})

    part, chars = None, 0
    for b in batches:
        for p, own, doc, text in zip(*(b.column(c).to_pylist() for c in ("part", "own", "doc_id", "text"))):
            if p != part or chars > 4 << 20:
                if (out := work(held)) is not None:
                    yield out
                held = held[-1:] if p == part else []
                chars = len(held[0][2]) if held else 0
                part = p
            held.append((own, doc, text))
            chars += len(text)
    if (out := work(held)) is not None:
        yield out


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and likenesses.

    Documents are dealt to ranges of their id that hold equally many bytes, one
    shuffle of the texts; the first document of each range is copied to the end
    of the range before it (one row per range), so every document meets its follower.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    ranges = byte_ranges(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if ranges is None:
        return spark.createDataFrame([], _SCHEMA)
    n = ranges.parts
    # Descending order: part 0 holds the largest ids, null ids are last.
    hashed = rows.withColumn("h", F.xxhash64("text"))
    ranged = hashed.withColumn("part", F.lit(n - 1) - ranges.part_of(F.col("doc_id"), F.col("h")))
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id").alias("id"), F.col("h").alias("h")))
    firsts = ranged.groupBy("part").agg(top.alias("top")).orderBy("part").collect()
    # The follower of a range's last document is the first of the next range that has any; after the last comes the very first.
    before = {r["part"]: firsts[k - 1]["part"] for k, r in enumerate(firsts)}
    tops = {r["part"]: (r["top"]["id"], r["top"]["h"]) for r in firsts}
    look = lambda values: F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), F.col("part"))
    is_top = F.col("doc_id").eqNullSafe(look([tops.get(k, (None, 0))[0] for k in range(n)])) & (F.col("h") == look([tops.get(k, (None, 0))[1] for k in range(n)]))
    here = F.struct(F.col("part").cast("int").alias("part"), F.lit(1).alias("own"))
    there = F.struct(look([before.get(k) for k in range(n)]).cast("int").alias("part"), F.lit(0).alias("own"))
    copies = F.when(is_top, F.array(here, there)).otherwise(F.array(here))
    dealt = ranged.select("doc_id", "h", "text", F.explode(copies).alias("c")).select("c.part", "c.own", "doc_id", "h", "text").repartitionById(n, "part")
    ordered = dealt.sortWithinPartitions("part", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
    return ordered.select("part", "own", "doc_id", "text").mapInArrow(_pair_rows, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bands long"


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row, without a shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for s in range(0, len(texts), 500):
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(s, 500), "fingerprint": fingerprints(texts[s:s + 500])})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def cell_links(prints: list[str], slice_of: np.ndarray, across: bool, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, partners j > i, likenesses) of all pairs at or above the threshold; ``across`` counts only pairs of different slices."""
    parts = [p.split(":") for p in prints]
    levels = np.array([int(p[0]) for p in parts])
    at: dict[int, np.ndarray] = {}
    for to in sorted(set(levels.tolist())):
        at[to] = np.zeros((len(prints), SAMPLES), np.uint8)
        for k in np.flatnonzero(levels <= to).tolist():
            x, down = _digits(parts[k][2]), to - levels[k]
            y = x if not down else _at_level(x, levels[k], to, -(-len(x) >> down))
            at[to][k, :len(y)] = y
    sizes = {to: np.count_nonzero(m, axis=1) for to, m in at.items()}
    for i in range(len(prints) - 1):
        after = np.arange(i + 1, len(prints))
        if across:
            after = after[slice_of[after] != slice_of[i]]
        higher = np.maximum(levels[after], levels[i])
        got = np.zeros(len(after))
        for to in set(higher.tolist()):
            here = np.flatnonzero(higher == to)
            js, n = after[here], sizes[to]
            # Lengths bound the likeness, so most unlike pairs aren't compared.
            used = np.maximum(n[js], n[i])
            close = np.minimum(n[js], n[i]) >= threshold * used
            here, js, used = here[close], js[close], used[close]
            same = (at[to][js, :n[i]] == at[to][i, :n[i]]).sum(axis=1)
            got[here] = np.where(used > 0, same / np.maximum(used, 1), 1.0)
        near = np.flatnonzero(got >= threshold)
        if len(near):
            yield i, after[near], got[near]


@lru_cache(maxsize=8 * CELL)
def _row(fingerprint: bytes) -> tuple[int, np.ndarray]:
    """Level and digits, padded to all samples."""
    level, _, body = fingerprint.decode().split(":")
    out = np.zeros(SAMPLES, np.uint8)
    out[:len(body)] = _digits(body)
    return int(level), out


def alike_prints(threshold: float):
    """One fingerprint against many: those at or above the threshold."""

    def alike(one: bytes, many: list[bytes]) -> np.ndarray:
        level, x = _row(one)
        rows = [_row(m) for m in many]
        out = np.zeros(len(many), bool)
        same = [k for k, (other, _) in enumerate(rows) if other == level]
        if same:
            y = np.stack([rows[k][1] for k in same])
            used = np.maximum(np.count_nonzero(y, axis=1), np.count_nonzero(x))
            out[same] = ((y == x) & (x > 0)).sum(axis=1) >= threshold * used - 1e-12
        for k, (other, _) in enumerate(rows):
            if other != level:
                out[k] = likeness(one.decode(), many[k].decode()) >= threshold
        return out

    return alike


def _verify(threshold: float):
    """Rows sorted by cell; emits per class its links within the cell, the best likeness and its root there."""

    def work(rows: list[tuple]) -> pa.RecordBatch | None:
        copies = np.array([r[4] for r in rows], np.int64)
        links, best = np.zeros(len(rows), np.int64), np.zeros(len(rows))

        def counted() -> Iterator[tuple[int, np.ndarray]]:
            for i, near, got in cell_links([r[6] for r in rows], np.array([r[5] for r in rows]), rows[0][1] != rows[0][2], threshold):
                links[i] += copies[near].sum()
                links[near] += copies[i]
                best[i] = max(best[i], got.max())
                best[near] = np.maximum(best[near], got)
                yield i, near

        roots = roots_of(len(rows), counted())
        met = np.flatnonzero(links)
        if not len(met):
            return None
        return pa.RecordBatch.from_pydict({"node": pa.array([rows[k][3] for k in met], pa.int64()), "links": links[met], "best": best[met],
                                           "root": pa.array([rows[roots[k]][3] for k in met.tolist()], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("block", "cell_i", "cell_j", "node", "copies", "slice", "fingerprint"))):
                if held and held[0][:3] != row[:3]:
                    if (out := work(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := work(held)) is not None:
            yield out

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 64, digits: int = 10) -> DataFrame:
    """(doc_id, representative, likeness, n_links) of every row that has a near duplicate, copies too.

    ``representative`` is the smallest id of all that are linked with it, directly
    or over others (null only if all are), ``n_links`` the number of other rows
    at or above the threshold, and ``likeness`` the highest with any of them. A
    pair at 0.8 shares one of 64 bands of 10 digits with a probability of at
    least 0.999, while unlike texts hardly ever do. Null texts count as empty,
    and empty ones are copies of each other; an empty input gives an empty output.
    """
    spark = docs.sparkSession
    coarser = max(1, math.ceil(-math.log2(threshold)))
    prints = materialise(fingerprint_table(docs), "edit-prints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Rows find their class again by a digest, a twentieth of a fingerprint.
    digest = F.unhex(F.md5("fingerprint"))
    classes = materialise(classes.withColumn("digest", digest).withColumn("node", F.monotonically_increasing_id()), "edit-classes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            found = [sorted({xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in band_keys(f, bands, digits, coarser, threshold * SAMPLES / 2)}) for f in b.column("fingerprint").to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "keys": pa.array(found, pa.list_(pa.int64()))})

    # A node lists each key once, so nothing has to be made distinct by a shuffle.
    keyed = classes.select("node", "fingerprint").mapInArrow(keys, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    keyed = materialise(keyed, "edit-keys")
    edges = bucket_links(keyed, classes.select("node", F.col("fingerprint").cast("binary").alias("sketch")), alike_prints(threshold), "edit-buckets")
    blocks = components(edges, "edit-blocks").withColumnRenamed("root", "block")

    wide = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m")).withColumn("slices", F.ceil(F.col("m") / CELL).cast("int")).select("block", "slices")
    member = join_hot(blocks, wide, "block", "node").join(classes, "node").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    # Every pair of slices is one cell; a class goes to the cells of its slice.
    celled = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "block", F.least("slice", "other").alias("cell_i"), F.greatest("slice", "other").alias("cell_j"), "node", "copies", "slice", "fingerprint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = celled.repartition(parts, "block", "cell_i", "cell_j").sortWithinPartitions("block", "cell_i", "cell_j", "node")
    verified = materialise(dealt.mapInArrow(_verify(threshold), "node long, links long, best double, root long"), "edit-links")

    linked = verified.groupBy("node").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    joined = components(verified.filter("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")), "edit-classes-of")
    named = classes.join(linked, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.filter((F.col("copies") > 1) | F.col("links").isNotNull())
    named = materialise(named, "edit-named")
    least = named.groupBy("root").agg(F.min("rep").alias("representative"))
    full = join_hot(named, least, "root", "node").select("digest", "representative", F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("best")).alias("likeness"),
                                            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return join_hot(prints.select("doc_id", digest.alias("digest")), full, "digest", "doc_id").select("doc_id", "representative", "likeness", "n_links")
