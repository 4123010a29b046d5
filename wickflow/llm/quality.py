"""Quality rules: a learned decision list over text statistics, native Spark only.

``text_stats`` derives the statistics with DataFrame functions, ``learn_rules``
grows and prunes threshold conjunctions by sequential covering over grouped
histograms, and ``verdict`` turns the list into one ordered ``CASE`` expression.

Defined results: null text counts as empty (no words; such rows fail the base
rule); null, empty and repeated rows keep one output row each; an empty input
gives an empty output; a list learned from no labels is empty and keeps
whatever passes the base rule. Other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickflow.llm.common import SPACE, materialise, text_of

#: Words in a repeated-passage window.
WINDOW = 5
#: Most labelled rows that take part in learning.
MAX_LABELLED = 50_000
#: Histogram bins per statistic: candidate thresholds are their edges.
BINS = 64
#: Ratio statistics that conditions may test.
FEATURES = (
    "symbol_ratio", "punct_ratio", "upper_ratio", "pipe_ratio", "dup_line_ratio",
    "repeat_ratio", "mean_word", "digit_ratio", "short_text",
)


def words_of(text: Column) -> Column:
    """Words of a text, in order."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _count_of(residue: Column, chars: str) -> Column:
    """How many of ``chars`` (a character class body) stand in ``residue``."""
    return F.length(F.regexp_replace(residue, f"[^{chars}]++", ""))


def _sorted_windows(hashes: Column) -> Column:
    """(hash, position) of every window, sorted."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated(pairs: Column) -> Column:
    """Sorted positions of the windows that equal a neighbour in sorted order.

    ``pairs`` has to be a column, not an expression: lambdas refer to it.
    """
    same = F.zip_with(F.slice(pairs, 1, F.size(pairs) - 1), F.slice(pairs, 2, F.size(pairs) - 1),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    return F.sort_array(F.array_distinct(F.flatten(same)))


def _union_length(at: Column) -> Column:
    """Words in the union of the windows that start at sorted positions."""
    steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
    return F.aggregate(steps, F.lit(WINDOW), lambda acc, s: acc + s).cast("long")


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts and the ratio statistics."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(docs, text_col).alias("t"))
    # Counts of marks, digits and capitals are taken on what lower-case letters and spaces leave.
    split = base.select("doc_id", words_of(F.col("t")).alias("w"), F.regexp_replace("t", rf"[a-z\u00DF-\u00F6\u00F8-\u00FF{SPACE}]++", "").alias("rest"),
                        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    n = F.size("w")
    hashed = split.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count_of(F.col("rest"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        _count_of(F.col("rest"), "|").alias("n_pipes"),
        _count_of(F.col("rest"), "!?.,;:").alias("n_punct"),
        _count_of(F.col("rest"), "0-9").alias("n_digits"),
        _count_of(F.col("rest"), "A-Z").alias("n_upper"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # A window's hash is that of its words' hashes, each taken once.
    hashed = hashed.withColumn("h", F.slice(
        F.transform("h", lambda x, i: F.xxhash64(x, *[F.get(F.col("h"), i + k) for k in range(1, WINDOW)])),
        1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))))
    # Sorting is left to texts in which some window does repeat.
    pairs = hashed.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), _sorted_windows(F.col("h")))).drop("h")
    at = pairs.withColumn("at", F.when(F.col("p").isNotNull(), _repeated(F.col("p")))).drop("p")
    counted = at.withColumn("n_repeat_words", F.when(F.size("at") > 0, _union_length(F.col("at"))).otherwise(F.lit(0).cast("long"))).drop("at")
    per_char = lambda c: F.when(F.col("word_chars") > 0, F.col(c) / F.col("word_chars")).otherwise(0.0)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per_char("n_symbols").alias("symbol_ratio"), per_char("n_punct").alias("punct_ratio"),
        per_char("n_upper").alias("upper_ratio"), per_char("n_pipes").alias("pipe_ratio"),
        per_char("n_digits").alias("digit_ratio"),
        F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(0.0).alias("dup_line_ratio"),
        F.when(F.col("n_words") > 0, F.col("n_repeat_words") / F.col("n_words")).otherwise(0.0).alias("repeat_ratio"),
        F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(0.0).alias("mean_word"),
        (1.0 / (1.0 + F.col("n_words"))).alias("short_text"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Reject when every condition holds."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))


def _bin_of(feature: str, edges: list[float]) -> Column:
    return F.size(F.filter(F.lit(edges), lambda e: e < F.col(feature)))


def _histograms(rows: DataFrame, edges: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(bad, good) by statistic and bin, in one pass that ships bins, not rows."""
    binned = rows.select("y", "fold", F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), _bin_of(f, es).alias("b")) for f, es in edges.items() if es
    ])).alias("x")) if any(edges.values()) else None
    out = {f: [(0, 0)] * (len(es) + 1) for f, es in edges.items()}
    if binned is None:
        return out
    for r in binned.groupBy("x.f", "x.b").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).collect():
        out[r["f"]][r["b"]] = (r["bad"], r["good"])
    return out


def _best_condition(hist, edges, have: tuple[int, int]) -> tuple[float, Condition] | None:
    """The condition with the largest FOIL information gain."""
    bad0, good0 = have
    if not bad0:
        return None
    info0 = math.log2(bad0 / (bad0 + good0))
    best = None
    for f in sorted(hist):
        bins = hist[f]
        total_bad, total_good = (sum(x[i] for x in bins) for i in (0, 1))
        below_bad = below_good = 0
        for k, e in enumerate(edges[f]):
            below_bad += bins[k][0]
            below_good += bins[k][1]
            for above, bad, good in ((True, total_bad - below_bad, total_good - below_good), (False, below_bad, below_good)):
                if bad <= 0:
                    continue
                gain = bad * (math.log2(bad / (bad + good)) - info0)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, Condition(f, above, e))
    return best


def _with_margin(rows: DataFrame, c: Condition) -> Condition:
    """The condition with its threshold halfway between the values it parts.

    Bin edges are values of rows, so ``> edge`` would reject at the least excess
    over what good rows show; the middle of the gap has the same coverage.
    """
    f = F.col(c.feature)
    r = rows.agg(F.max(F.when(f <= c.threshold, f)).alias("below"), F.min(F.when(f > c.threshold, f)).alias("above")).first()
    if r["below"] is None or r["above"] is None:
        return c
    return Condition(c.feature, c.above, (r["below"] + r["above"]) / 2)


def learn_rules(labelled: DataFrame, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Sequential covering on rows of statistics with ``y`` (1: to be rejected) and ``fold``.

    Each rule grows on two thirds of the rows (fold 0, 1) by information gain
    and is pruned on the last third (fold 2) to the prefix of conditions with
    the best (bad - good) / (bad + good); rules below ``min_precision`` there end
    the list. Rows travel only as histogram bins; the driver sees at most
    ``BINS`` x ``FEATURES`` counts per step.
    """
    quantiles = [k / BINS for k in range(1, BINS)]
    row = labelled.agg(*[F.percentile_approx(f, quantiles, 2000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(row[f] or [])) for f in FEATURES}
    rules: list[Rule] = []
    left = labelled
    for _ in range(max_rules):
        grow, prune = left.filter("fold < 2"), left.filter("fold = 2")
        chosen: list[Condition] = []
        while len(chosen) < max_conditions:
            covered = reduce(lambda d, c: d.filter(c.column()), chosen, grow)
            hist = _histograms(covered, edges)
            bins = next((b for b in hist.values() if sum(map(sum, b))), [])
            have = tuple(sum(x[i] for x in bins) for i in (0, 1)) or (0, 0)
            best = _best_condition(hist, edges, have)
            if best is None or best[0] <= 1e-9:
                break
            chosen.append(_with_margin(covered, best[1]))
            if have[1] == 0:
                break
        if not chosen:
            break
        prefixes = [reduce(lambda a, b: a & b, (c.column() for c in chosen[:k])) for k in range(1, len(chosen) + 1)]
        counts = prune.agg(*[x for k, p in enumerate(prefixes) for x in (
            F.coalesce(F.sum(F.when(p, F.col("y"))), F.lit(0)).alias(f"b{k}"), F.coalesce(F.sum(F.when(p, 1 - F.col("y"))), F.lit(0)).alias(f"g{k}"))]).first()
        scored = [((counts[f"b{k}"] - counts[f"g{k}"]) / max(counts[f"b{k}"] + counts[f"g{k}"], 1), -k) for k in range(len(chosen))]
        keep = -max(scored)[1]
        bad, good = counts[f"b{keep}"], counts[f"g{keep}"]
        if bad + good < min_covered or bad / (bad + good) < min_precision:
            break
        rules.append(Rule(tuple(chosen[: keep + 1]), bad / (bad + good), bad + good))
        left = left.filter(~rules[-1].column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects the row, in list order; 0: none."""
    out = None
    for k, r in enumerate(rules, 1):
        out = F.when(r.column(), k) if out is None else out.when(r.column(), k)
    return out.otherwise(0) if out is not None else F.lit(0)


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The list learned from ``docs`` and ``labels`` (doc_id, quality).

    At most about ``MAX_LABELLED`` labelled rows, by hash of the id, take part;
    statistics are taken of their texts alone. Repeated labels of an id count as
    the best of them; a label without a document is left out.
    """
    marks = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    n = marks.count()
    if n > MAX_LABELLED:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * MAX_LABELLED / n))
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__quality")).limit(2 * MAX_LABELLED)
    # The marks are bounded, so they are broadcast and the texts don't move.
    marked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "__id").select(F.struct("__id", "__quality").alias("row"), "text")
    rows = materialise(text_stats(marked, id_col="row"), "quality-labelled").filter(~base_failed()).select(
        *FEATURES, (F.col("doc_id.__quality") == 0).cast("long").alias("y"), F.pmod(F.xxhash64(F.lit("fold"), "doc_id.__id"), F.lit(3)).alias("fold"))
    return learn_rules(materialise(rows.coalesce(max(1, min(8, n // 20_000))), "quality-learnt"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """Statistics of every row with base_failed, rule and kept; the learned list. One pass over all texts."""
    rules = learned(docs, labels, id_col, text_col)
    return text_stats(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    Rules are learned from the labelled sample first; one pass then judges each
    row where it is, so no text is shuffled. The row number keeps the optimizer
    from pushing the filter below the statistics, which would repeat their
    expressions once per use.
    """
    rules = learned(docs, labels)
    rows = text_stats(docs.withColumn("__row", F.struct(*docs.columns)), id_col="__row").withColumn("__n", F.monotonically_increasing_id())
    return rows.filter((F.col("__n") >= 0) & ~base_failed() & (verdict(rules) == 0)).select("doc_id.*")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out, _ = judged(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
