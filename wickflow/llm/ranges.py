"""Ranges of document ids with about equally many bytes of text.

Rows go to ``parts`` ranges in ascending order of id, null ids first. Ids are
cut into many fine ranges by approximate quantiles, and fine ranges are joined
by their exact bytes, so long documents and dense ids don't swell a part. An id
that alone holds more than two parts' bytes is spread over several by a hash of
the text, which is the second key of the order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes a part aims at, and the least where fewer would leave cores idle.
PART_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
#: Most fine ranges; the driver holds a few numbers for each.
MAX_RANGES = 20_000


def _constant(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def range_of(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below a value: binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    constant = _constant(bounds)
    # Searches by powers of two; each step is one look-up.
    return F.aggregate(F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))]), F.lit(0), lambda acc, s: F.when(
        (acc + s <= len(bounds)) & (F.get(constant, acc + s - 1) < column), acc + s).otherwise(acc))


@dataclass(frozen=True)
class Ranges:
    """Upper bounds of all ranges but the last, and the first part and number of parts of each; range 0 is that of null ids."""

    bounds: list[int]
    first: list[int]
    split: list[int]

    @property
    def parts(self) -> int:
        return self.first[-1] + self.split[-1]

    def part_of(self, doc_id: Column, text_hash: Column) -> Column:
        r = F.when(doc_id.isNull(), 0).otherwise(1 + range_of(doc_id, self.bounds))
        part = F.get(_constant(self.first), r)
        if max(self.split) > 1:
            part = part + F.pmod(text_hash, F.get(_constant(self.split), r))
        return part.cast("int")


def joined(fine: list[tuple[int, int, bool]], parts: int) -> tuple[list[int], list[int], list[int]]:
    """Join consecutive fine ranges (number, bytes, single id) to about ``parts`` even ones.

    Returns the last fine number of each, its first part and its number of parts.
    """
    goal = max(1, sum(b for _, b, _ in fine) / parts)
    last, first, split, held, at = [], [], [], 0.0, 0

    def close(number: int, k: int) -> None:
        nonlocal held, at
        last.append(number)
        first.append(at)
        split.append(k)
        at += k
        held = 0.0

    for i, (number, size, single) in enumerate(fine):
        if single and size > 2 * goal:
            if held:
                close(fine[i - 1][0], 1)
            close(number, round(size / goal))
            continue
        if held and held + size / 2 > goal:
            close(fine[i - 1][0], 1)
        held += size
    if held:
        close(fine[-1][0], 1)
    return last, first, split


def byte_ranges(rows: DataFrame, least_parts: int, part_bytes: int = PART_BYTES) -> Ranges | None:
    """Ranges for ``rows`` (doc_id long, text string); None if there are none."""
    n = rows.count()
    if not n:
        return None
    fine = min(MAX_RANGES, max(1, n // 8))
    got = rows.agg(F.percentile_approx("doc_id", [k / fine for k in range(1, fine)] or [0.5], max(10_000, 5 * fine)).alias("q")).first()["q"]
    bounds = sorted(set(got or []))
    number = F.when(F.col("doc_id").isNull(), -1).otherwise(range_of(F.col("doc_id"), bounds))
    sized = rows.groupBy(number.alias("r")).agg((F.sum(F.octet_length("text")) + F.count(F.lit(1))).alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()
    held = sorted((r["r"], r["b"], r["lo"] == r["hi"]) for r in sized if r["r"] >= 0)
    nulls = sum(r["b"] for r in sized if r["r"] < 0)
    total = nulls + sum(b for _, b, _ in held)
    parts = max(-(-total // part_bytes), min(least_parts, -(-total // LEAST_BYTES)))
    null_parts = max(1, round(nulls * parts / total)) if nulls else 0
    last, first, split = joined(held, max(1, parts - null_parts)) if held else ([], [0], [1])
    if not held:
        return Ranges([], [0, null_parts], [null_parts, 1])
    return Ranges([bounds[r] for r in last[:-1]], [0, *[f + null_parts for f in first]], [max(null_parts, 1), *split])
