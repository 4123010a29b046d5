"""Mixing sources to target weights: capped water-filling, native Spark only.

Each source asks for ``weight / sum of weights`` of the total; targets above
``max_epochs`` times the source's size are clamped and their excess is shared
again by weight until none is above. A source's target becomes whole
repetitions of all its documents plus a seeded fraction of them: documents
below a hash threshold are taken once more, and the documents at the threshold
contribute the words that are still missing, so a source's taken words meet its
target to within a word per row at the threshold.

Defined results: null text has size 0; a null source is a source of its own,
last in order; equal rows share one hash and so one fate (they split what is
missing at the threshold); a source without words has target 0; an empty input
gives an empty output. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.llm.common import SPACE, join_dimension, materialise, text_of

#: Buckets of the sampling hash per source; only one bucket of each is ever ordered row by row.
BUCKETS = 4096
#: Bits of the sampling hash.
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters."""
    return F.size(F.array_remove(F.split(text, f"[{SPACE}]+"), "")).cast("long")


def _sample_hash(seed: int) -> Column:
    """A 60-bit hash of the document id and size, the same in any SQL engine with md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, budget: Column, max_epochs: float) -> DataFrame:
    """Add ``target`` to one row per source with ``source``, ``source_size`` and ``weight``.

    Clamping in order of capacity per weight finds the same fixed point as
    repeated redistribution: the first k sources are clamped where the level of
    the rest stays above their own. The windows stream over one row per source.
    """
    ratio = F.col("cap") / F.col("weight")
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "source").rowsBetween(0, Window.unboundedFollowing)
    capped = sources.withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("ratio", ratio)
    filled = capped.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open_weight", F.sum("weight").over(rest))
    level = filled.withColumn("level", (budget - F.col("used")) / F.col("open_weight"))
    everyone = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, 0)
    # The first source whose share at its level fits fixes the level of all that follow.
    fixed = level.withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.struct("used", "open_weight")))
    fixed = fixed.withColumn("fix", F.first("fits", ignorenulls=True).over(everyone))
    share = (budget - F.col("fix.used")) * F.col("weight") / F.col("fix.open_weight")
    return fixed.withColumn("target", F.when(F.col("fix").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), share))).select("source", "source_size", "weight", "target")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget_ratio: float, max_epochs: float) -> DataFrame:
    """One row per source: source_size, weight by rank of the source, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ready = ranked.withColumn("weight", weight).withColumn("budget", F.sum("source_size").over(total) * F.lit(budget_ratio))
    return water_fill(ready, F.col("budget"), max_epochs)


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *keep: Column) -> DataFrame:
    """doc_id, source, size, sampling hash and a null-safe source key, beside ``keep``."""
    raw = docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(docs, text_col)).alias("size"))
    return raw.withColumns({"h": _sample_hash(seed), "key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))})


def source_plan(sizes: DataFrame, weights: tuple[float, ...], budget_ratio: float, max_epochs: float) -> DataFrame:
    """One row per source: target, whole repetitions, and where its fraction ends.

    Sums by (source, hash bucket) locate each source's threshold bucket, and
    only that bucket, one part in ``BUCKETS`` of the source, is ordered by hash.
    """
    targets = source_targets(sizes, weights, budget_ratio, max_epochs).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(rate), F.lit(int(max_epochs))).cast("long")
    targets = materialise(targets.withColumn("whole", whole).withColumn(
        "extra", F.greatest(F.floor(F.col("target") - F.col("whole") * F.col("source_size")), F.lit(0)).cast("long")).drop("weight", "source"), "mix-targets")
    sizes = sizes.withColumn("bucket", F.shiftright("h", HASH_BITS - 12))
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = sizes.groupBy("key", "bucket").agg(F.sum("size").alias("words")).withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = by_bucket.join(targets.select("key", "extra"), "key").filter("below <= extra and extra < below + words").select("key", "bucket", "below", "extra")
    edge = materialise(edge, "mix-edge")
    inside = join_dimension(sizes, edge, ["key", "bucket"], "inner").groupBy("key", "h").agg(F.sum("size").alias("words"), F.first("below").alias("below"), F.first("extra").alias("extra"))
    upto_h = Window.partitionBy("key").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(upto_h), F.lit(0))).filter("before <= extra and extra < before + words")
    cut = cut.select("key", F.col("h").alias("cut"), (F.col("extra") - F.col("before")).alias("missing"), F.col("words").alias("at_cut"))
    return materialise(targets.join(cut, "key", "left"), "mix-plan")


def _taken() -> Column:
    """Words the mix takes of a row: whole repetitions and its share of the fraction.

    Without a threshold the fraction is empty or the whole source.
    """
    partial = F.when(F.col("cut").isNull(), F.when(F.col("extra") > 0, F.col("size")).otherwise(0)).when(
        F.col("h") < F.col("cut"), F.col("size")).when(
        F.col("h") == F.col("cut"), F.expr("(missing * size) div at_cut")).otherwise(0)
    return (F.col("whole") * F.col("size") + partial).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    Texts are read once; sizes and hashes go to a table in the shared folder.
    """
    sizes = materialise(_keyed(docs, seed, id_col, text_col, source_col), "mix-sizes")
    plan = source_plan(sizes, weights, budget_ratio, max_epochs)
    return join_dimension(sizes, plan, ["key"]).select("doc_id", "source", "size", "source_size", "target", _taken().alias("taken"))


def repeat_rows(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: documents repeated as often as they are taken.

    A fractional repetition at a source's threshold is the document's first
    words, spaced as they are there. Every row finds its own fate from its source's plan, so texts don't
    move as long as the sources are few enough to broadcast.
    """
    plan = source_plan(materialise(_keyed(docs, seed, "doc_id", "text", "source"), "mix-sizes"), weights, budget_ratio, max_epochs)
    row = F.struct(*docs.columns).alias("row")
    met = join_dimension(_keyed(docs, seed, "doc_id", "text", "source", row), plan, ["key"]).select("row", "size", _taken().alias("taken"))
    wholes = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    # Cut after each word, so that every word keeps the space before it.
    head = F.array_join(F.slice(F.split(F.col("row.text"), f"(?<=[^{SPACE}])(?=[{SPACE}])"), 1, part), "")
    versions = F.concat(F.array_repeat(F.lit(False), wholes.cast("int")), F.when(part > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    out = met.withColumn("head", F.when(part > 0, head)).select("row", "head", F.explode(versions).alias("cut"))
    made = {"text": F.when(F.col("cut"), F.col("head")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("cut"), F.length("head").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sql(weights: tuple[float, ...] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> str:
    """The same mix for DuckDB over ``documents``."""
    choose = " ".join(f"WHEN {k} THEN CAST({w} AS DOUBLE)" for k, w in enumerate(weights))
    return f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
hashed AS (SELECT *, CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size), 1, {HASH_BITS // 4}) AS BIGINT) AS h FROM sizes),
per AS (SELECT source, key, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source, key),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {choose} END AS weight,
                  sum(source_size) OVER () * CAST({budget_ratio} AS DOUBLE) AS budget, source_size * CAST({max_epochs} AS DOUBLE) AS cap FROM per),
filled AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                  sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM ranked),
fix AS (SELECT used AS fix_used, open_weight AS fix_weight FROM filled WHERE (budget - used) / open_weight <= cap / weight
        ORDER BY cap / weight, source NULLS FIRST LIMIT 1),
targets AS (SELECT key, source_size, CASE WHEN fix_used IS NULL OR used < fix_used THEN cap ELSE least(cap, (budget - fix_used) * weight / fix_weight) END AS target
            FROM filled LEFT JOIN fix ON true),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), {int(max_epochs)}) AS BIGINT) ELSE 0 END AS whole FROM targets),
extra AS (SELECT *, CAST(greatest(floor(target - whole * source_size), 0) AS BIGINT) AS extra FROM plan),
at_hash AS (SELECT key, h, CAST(sum(size) AS BIGINT) AS words FROM hashed GROUP BY key, h),
running AS (SELECT *, coalesce(CAST(sum(words) OVER (PARTITION BY key ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM at_hash),
cut AS (SELECT r.key, r.h AS cut, e.extra - r.before AS missing, r.words AS at_cut FROM running r JOIN extra e USING (key) WHERE r.before <= e.extra AND e.extra < r.before + r.words)
SELECT d.doc_id, d.source, d.size, e.source_size, e.target,
       CAST(e.whole * d.size + CASE WHEN c.cut IS NULL THEN CASE WHEN e.extra > 0 THEN d.size ELSE 0 END
            WHEN d.h < c.cut THEN d.size WHEN d.h = c.cut THEN (c.missing * d.size) // c.at_cut ELSE 0 END AS BIGINT) AS taken
FROM hashed d JOIN extra e USING (key) LEFT JOIN cut c USING (key)
"""
