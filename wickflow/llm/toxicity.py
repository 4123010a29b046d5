"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and word prefixes, hashed to 62 bits. Terms are screened on
labelled rows, both ways: by how far their share among toxic rows lies from
that among others, in all rows and once more in the rows that hold a term of
the first screen. So a group mention that counts only beside an insult enters
as well as words that speak for a clean text. The machine learns a weight and a
factor vector for each kept term, and pairs of terms (an insult with a group
mention) add what single weights miss. Scoring is one pass over all texts
without a shuffle.

Learning uses at most ``MAX_LABELLED`` labelled rows, chosen by a hash of the
id, never the held-out fifth, and each distinct text once. Scores depend on the
text alone. Defined results: null and empty texts get the machine's bias;
without usable labels every score is 0; every row keeps one output row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import materialise, ship, text_of

#: Most labelled rows that are learned from.
MAX_LABELLED = 20_000
#: Most terms of either screen, the clearest first.
MAX_TERMS = 2048
#: Least screening score of a term, in standard deviations, and least rows that hold it.
MIN_Z, MIN_ROWS = 4.9, 5
FACTORS = 8
PREFIXES = (4, 5, 6)
#: Most distinct pieces of text whose terms a worker remembers.
MEMO = 500_000

_WORD = re.compile(r"[^\W\d_]+")
_memos: dict[int, dict[str, tuple[int, ...]]] = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms_of(piece: str) -> list[int]:
    """Hashed terms of a piece of text: its words and their prefixes."""
    import xxhash

    found = {w for w in _WORD.findall(piece.lower())}
    found |= {f"{w[:k]}*" for w in found for k in PREFIXES if len(w) > k}
    return [xxhash.xxh3_64_intdigest(t) >> 2 for t in found]


def text_terms(text: str) -> set[int]:
    return {t for p in set(text.split()) for t in terms_of(p)}


@dataclass(frozen=True)
class Machine:
    """bias + weights + factors over ``terms`` (term hash to row)."""

    bias: float
    terms: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[int]) -> float:
        z = self.bias
        if rows:
            v = self.factors[rows]
            s = v.sum(axis=0)
            z += float(self.weights[rows].sum() + 0.5 * (s @ s - (v * v).sum()))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[list[int]], labels: list[int], terms: list[int], epochs: int = 60, batch: int = 512, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Logistic factorization machine by Adam over present-or-absent terms."""
    rng = np.random.default_rng(seed)
    n, k = len(rows), len(terms)
    y = np.asarray(labels, np.float32)
    p = (y.sum() + 0.5) / (n + 1.0)
    params = [np.array([math.log(p / (1 - p))], np.float32), np.zeros(k, np.float32), rng.normal(0, 0.05, (k, FACTORS)).astype(np.float32)]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    step = 0
    for _ in range(epochs if k else 0):
        order = rng.permutation(n)
        for s in range(0, n, batch):
            take = order[s:s + batch]
            x = np.zeros((len(take), k), np.float32)
            for i, r in enumerate(take):
                x[i, rows[r]] = 1.0
            b, w, f = params
            sums = x @ f
            z = b + x @ w + 0.5 * ((sums**2).sum(1) - x @ (f**2).sum(1))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)
            grads = [np.array([err.sum()]), x.T @ err + decay * w, x.T @ (err[:, None] * sums) - (x.T @ err)[:, None] * f + decay * f]
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                params[j] = params[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), {t: i for i, t in enumerate(terms)}, params[1].astype(np.float64), params[2].astype(np.float64))


def _count_terms(anchors: frozenset[int] | None):
    """Rows per term by label, and in all as term -1; a task counts its share of the bounded sample.

    With ``anchors`` only rows that hold one of them count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                terms = text_terms(text)
                if anchors is None or not anchors.isdisjoint(terms):
                    seen[y].update(terms)
                    seen[y][-1] += 1
        keys = list(seen[0].keys() | seen[1].keys())
        for s in range(0, len(keys), 50_000):
            cut = keys[s:s + 50_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(cut, pa.int64()), "neg": pa.array([seen[0][t] for t in cut], pa.int64()), "pos": pa.array([seen[1][t] for t in cut], pa.int64())})

    return run


def _screen(sample: DataFrame, anchors: frozenset[int] | None = None) -> list[tuple[int, float]]:
    """(term, z) of the terms whose share among toxic rows differs clearly from that among others."""
    counts = materialise(sample.mapInArrow(_count_terms(anchors), "term long, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "toxic-terms")
    every = counts.filter("term = -1").first()
    neg, pos = (every["neg"], every["pos"]) if every else (0, 0)
    if not neg or not pos:
        return []
    share = (F.col("neg") + F.col("pos")) / (neg + pos)
    z = (F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(share * (1.000001 - share) * (1 / pos + 1 / neg))
    clear = counts.filter((F.col("term") >= 0) & (F.col("neg") + F.col("pos") >= MIN_ROWS)).withColumn("z", z).filter(F.abs("z") >= MIN_Z)
    return [(r["term"], r["z"]) for r in clear.orderBy(F.desc(F.abs("z")), "term").limit(MAX_TERMS).collect()]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine | None:
    """The machine for ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    ship(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    n = marks.count()
    if n > max_labelled:
        marks = marks.filter(F.pmod(F.xxhash64(F.lit("fm"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).limit(2 * max_labelled)
    # The sample's size is bounded, so it is broadcast and the texts don't move.
    rows = docs.join(F.broadcast(marks), "doc_id").select("y", "text")
    sample = materialise(rows.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.max("y").alias("y"), F.first("text").alias("text")).select("y", "text"), "toxic-sample")
    first = _screen(sample)
    if not first:
        totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
        if not totals["pos"] or totals["pos"] == totals["n"]:
            return None
    toxic = frozenset(t for t, z in first if z > 0)
    terms = list(dict.fromkeys([t for t, _ in first] + [t for t, _ in (_screen(sample, toxic) if toxic else [])]))
    known = {t: i for i, t in enumerate(terms)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({known[t] for t in text_terms(x) if t in known}) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "rows": pa.array(found, pa.list_(pa.int32()))})

    seen = sorted((tuple(r["rows"]), r["y"]) for r in sample.mapInArrow(present, "y int, rows array<int>").collect())
    return fit([list(r) for r, _ in seen], [y for _, y in seen], terms)


def score_texts(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""
    if machine is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo = _memos.setdefault(hash((m.bias, len(m.terms), *list(m.terms)[:8])), {})
        for b in batches:
            scores = []
            for text in b.column("text").to_pylist():
                pieces = set(text.split())
                for p in pieces.difference(memo):
                    memo[p] = tuple(m.terms[t] for t in terms_of(p) if t in m.terms)
                scores.append(m.score(sorted({i for p in pieces for i in memo[p]})))
                if len(memo) > MEMO:
                    memo.clear()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(scores, pa.float64())})

    return docs.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    scored = score_texts(rows, train(rows, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
