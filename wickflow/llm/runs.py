"""Periodic runs of words, by a harmonic grid of longest common extensions.

A run is a stretch of words with smallest period q, at least ``max(24, 3 q)``
words long, that no neighbouring word extends with the same period. For every
period p the grid asks how far the words at jp and (j+1)p agree to the right and
to the left; a run of period p holds two such places, so no run is missed, and
the number of questions is n times a harmonic sum. An answer is a minimum over
neighbouring suffixes' common prefixes: a suffix array with a range-minimum
table to the right, that of the reversed words to the left.

Documents are taken in groups of about ``GROUP_WORDS`` words, each between
separators of its own, so that one array serves a group. A run repeats some
window of 16 words; a document without such a window holds no run and is left
out before the arrays are built.

Defined results: null and empty texts have no words and no runs; null ids count
as planting nothing; every row keeps one row; an empty input gives an empty
output. Whole texts are read; a document has to fit in a task, at about 200 bytes
a word. No shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import ship, text_of

#: Least words of a run, and least periods it holds.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a group of documents; questions that are asked at once.
GROUP_WORDS, QUESTIONS = 1 << 16, 1 << 20
#: A run of at least 24 words and three periods repeats a window of this many words.
WINDOW = 16

_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]


def windows(codes: np.ndarray) -> list[np.ndarray]:
    """Order of the windows of 1, 2, 4, ... codes at each place, until no two are equal; the last is that of the suffixes."""
    n, span = len(codes), 1
    out = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
    while int(out[-1].max()) + 1 < n:
        after = np.zeros(n, np.int64)
        after[:n - span] = out[-1][span:] + 1
        out.append(np.unique(out[-1].astype(np.int64) * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
        span *= 2
    return out


class Extensions:
    """How many codes two places have in common to their right: suffix array, neighbours' common prefixes, range minima."""

    def __init__(self, codes: np.ndarray) -> None:
        levels = windows(codes)
        self.rank, n = levels[-1], len(codes)
        array = np.empty(n, np.int64)
        array[self.rank] = np.arange(n)
        a, b, common = array[:-1].copy(), array[1:].copy(), np.zeros(n, np.int32)
        for k in range(len(levels) - 2, -1, -1):
            same = levels[k][a] == levels[k][b]
            step = np.where(same, 1 << k, 0)
            a, b = a + step, b + step
            common[1:] += step.astype(np.int32)
        del levels
        # Row k of the table has the minima of 2**k neighbours.
        self.table = [common]
        while 2 << (len(self.table) - 1) <= n:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a and b that differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        row = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(row):
            at = row == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k)) + 1])
        return out


def _questions(sizes: list[int], starts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid of each document, in blocks; periods ascend within a document."""
    places, periods, held = [], [], 0
    for n, at in zip(sizes, starts):
        p = np.arange(1, n // LEAST_PERIODS + 1)
        counts = (n - 1) // p
        cuts = np.flatnonzero(np.diff(np.cumsum(counts) // QUESTIONS)) + 1
        for block, c in zip(np.split(p, cuts), np.split(counts, cuts)):
            each = np.repeat(block, c)
            j = np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c)
            places.append(at + j * each)
            periods.append(each)
            held += len(each)
            if held >= QUESTIONS:
                yield np.concatenate(places), np.concatenate(periods)
                places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def _may_hold_runs(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Documents (their numbers) with a repeated window; unequal windows of equal hash only cost time."""
    h, factor = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
    h ^= h >> np.uint64(29)
    span = 1
    while span < WINDOW:
        h = h[:-span] * np.uint64(factor) + h[span:]
        span, factor = 2 * span, factor * factor % (1 << 64)
    order = np.argsort(h)
    return np.unique(owner[order[1:][h[order[1:]] == h[order[:-1]]]])


def find_runs(documents: list[list[int]]) -> list[list[Run]]:
    """(start, length, period) of all runs of each document, by start and period.

    A document is a list of word numbers from 0, of its own.
    """
    out: list[list[Run]] = [[] for _ in documents]
    chosen = [d for d, words in enumerate(documents) if len(words) >= LEAST_WORDS]
    for screened in (False, True):
        if not chosen:
            return out
        # A separator before, between and after documents; no code occurs in two of them.
        pieces, owners, starts, code, at = [np.array([0])], [np.array([-1])], [], 1, 1
        for d in chosen:
            words = np.asarray(documents[d], np.int64)
            top = int(words.max()) + 1
            starts.append(at)
            pieces += [words + code, np.array([code + top])]
            owners.append(np.full(len(words) + 1, d))
            code, at = code + top + 1, at + len(words) + 1
        codes, owner = np.concatenate(pieces), np.concatenate(owners)
        if not screened:
            chosen = [int(d) for d in _may_hold_runs(codes, owner)]
    n = len(codes)
    right, left = Extensions(codes), Extensions(codes[::-1])
    found = [[], [], []]
    for place, period in _questions([len(documents[d]) for d in chosen], starts):
        ahead = right(place, place + period)
        back = left(n - place, n - place - period)
        hit = ahead + back + period >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        for x, v in zip(found, (place[hit] - back[hit], (place + period + ahead)[hit], period[hit])):
            x.append(v)
    begin, end, period = (np.concatenate(x) for x in found)
    # Of equal stretches the smallest period is a run's; the others are its multiples.
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    base = dict(zip(chosen, starts))
    for s, e, p in sorted(zip(begin[first].tolist(), end[first].tolist(), period[first].tolist()), key=lambda r: (r[0], r[2])):
        d = int(owner[s])
        out[d].append((s - base[d], e - s, p))
    return out


def numbered(words: list[str]) -> list[int]:
    """Words as numbers from 0."""
    known = dict.fromkeys(words)
    for k, w in enumerate(known):
        known[w] = k
    return [known[w] for w in words]


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words as the audit wants them: in a tenth of the documents, chosen by id, the rest of the text repeats."""
    if doc_id is None or not words:
        return words
    g, chosen = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if chosen:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * (-(-(n - a) // len(cycle))))[:n - a]


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words that stand in no run after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return words if keep.all() else [words[i] for i in np.flatnonzero(keep)]


def _grouped(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[tuple[list, list[list[str]], list[list[Run]]]]:
    """(ids, words, runs) of groups of documents."""
    for b in batches:
        ids, words, held = [], [], 0
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            found = _WORD.findall(text)
            ids.append(doc_id)
            words.append(planted(found, doc_id) if plant else found)
            held += len(found)
            if held >= GROUP_WORDS:
                yield ids, words, find_runs([numbered(w) for w in words])
                ids, words, held = [], [], 0
        if ids:
            yield ids, words, find_runs([numbered(w) for w in words])


def _rows(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))


def run_spans(docs: DataFrame) -> DataFrame:
    """One row per run: doc_id, start, length, period in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, runs in _grouped(batches, False):
            rows = [(i, *r) for i, found in zip(ids, runs) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), (), ()))], names=["doc_id", "start", "length", "period"])

    return _rows(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, runs cut to their first period; texts with a run are rejoined by single spaces, others stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = b.column("text").to_pylist(), 0
            for ids, words, runs in _grouped(iter([b]), False):
                kept = [" ".join(collapsed(w, r)) if r else t for w, r, t in zip(words, runs, texts[at:at + len(ids)])]
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return _rows(docs).mapInArrow(run, "doc_id long, text string")


_REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document, periods planted in a tenth: number of runs, the run of greatest exponent, digests of runs and collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _grouped(batches, True):
            best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None) for r in runs]
            top = lambda k: pa.array([b and b[k] for b in best], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), top(0), top(1), top(2), pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                pa.array([_sha("".join(f"{s},{n},{p}\n" for s, n, p in r)) for r in runs]), pa.array([_sha(" ".join(collapsed(w, r))) for w, r in zip(words, runs)])],
                names=[c.split()[0] for c in _REPORT.split(", ")])

    return _rows(docs).mapInArrow(run, _REPORT)
