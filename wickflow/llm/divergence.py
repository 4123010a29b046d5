"""Which sources of a language speak differently, and by which words.

Terms are counted once, pre-aggregated inside each task. A language keeps the
terms that stand in at least ``MIN_DOCS`` of its documents, and every source
gives each kept term a smoothed share in billionths, counts of zero included.
All arithmetic is on whole numbers.

Pairs of sources differ by a sum over all kept terms, of which most stand in
neither source. So the sum starts from what it were if both held none, and is
corrected where one source has a term (grouped by equal shares) and where both
have it: work follows the counted terms, not the vocabulary times the pairs.

The most telling terms of a source come from a radix selection: histograms of
the values' digits, from the highest, find the value of the k-th; terms of just
that value are cut by histograms of their UTF-8 bytes.

Defined results: null text, lang and source count as empty strings; repeated
rows count each; a source without kept terms has pairs and no terms, a language
without kept terms pairs of value 0; a language of one source has no pairs; an
empty input gives an empty output. Other columns are ignored. Shares are exact
up to 9 * 10^15 words in a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.llm.common import join_dimension, materialise, ship, text_of

#: Least documents of a language that hold a kept term.
MIN_DOCS = 10
#: Ranks of telling terms.
TOP = 10
#: Shares are in parts of this many, by long division in ``STEPS`` decimal groups.
SCALE, STEPS = 1000, 3
#: Bits of a value, and bytes of a term, that one histogram tells apart.
DIGIT_BITS, DIGIT_BYTES = 11, 2
#: Equal terms at the threshold that may be left to the final sort of a group.
FINISH = 512
#: Distinct terms that a task holds before it passes its counts on.
FLUSH = 400_000

#: Everything that is no term as a space; A-Z are lower-cased before.
_TERMS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Terms in their order: stretches of ASCII letters, lower-cased, and other characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences, documents; an empty term stands for the group itself."""
    counts, in_docs, held = defaultdict(Counter), defaultdict(Counter), 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            terms, docs = [b"", *found], in_docs[lang, source]
            cols = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *found.values()], pa.int64()), pa.array([0, *(docs[t] for t in found)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "c", "d"])

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            terms, mine = terms_of(text), counts[lang, source]
            before = len(mine)
            mine.update(terms)
            in_docs[lang, source].update(set(terms))
            held += len(mine) - before
            if held > FLUSH:
                yield from flush()
                counts, in_docs, held = defaultdict(Counter), defaultdict(Counter), 0
    yield from flush()


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 2) / total), exact; null for a total of 0."""
    whole, rest, total = F.lit(0).cast("long"), count + 2, F.nullif(total, F.lit(0).cast("long"))
    for _ in range(STEPS):
        whole, rest = whole * SCALE + F.call_function("div", rest * SCALE, total), rest * SCALE % total
    return whole + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, count, lang_count) of kept terms that a group has, and one row per group.

    A group's row: lang, source, total and its share of a term it lacks
    (``none``), lang_total, and v, the language's kept terms. The totals include
    the smoothing.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_of(docs).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, source string, term string, c long, d long").groupBy("lang", "source", "term").agg(F.sum("c").alias("count"), F.sum("d").alias("d"))
    # A term has at most a row for each source by now.
    w = Window.partitionBy("lang", "term")
    seen = counts.withColumns({"docs": F.sum("d").over(w), "lang_count": F.sum("count").over(w), "first": F.min("source").over(w)})
    seen = materialise(seen.filter((F.col("docs") >= MIN_DOCS) | (F.col("term") == "")).drop("d", "docs"), "divergence-terms")
    is_term = F.col("term") != ""
    langs = seen.groupBy("lang").agg(F.sum("count").alias("n"), F.count_if(is_term & (F.col("source") == F.col("first"))).alias("v"))
    groups = join_dimension(seen.groupBy("lang", "source").agg(F.sum("count").alias("own")), materialise(langs, "divergence-langs"), ["lang"], "inner")
    groups = groups.select("lang", "source", "v", (F.col("own") + 2 * F.col("v")).alias("total"), (F.col("n") + 2 * F.col("v")).alias("lang_total"))
    return seen.filter(is_term).drop("first"), materialise(groups.withColumn("none", share(F.lit(0).cast("long"), F.col("total"))), "divergence-groups")


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources; ``terms`` has lang, source, term, p."""
    mine = groups.select("lang", "source", "v", F.col("none").alias("own"))
    other = groups.select("lang", F.col("source").alias("item"), "none")
    apart = F.col("source") != F.col("item")
    empty = gap(F.col("own"), F.col("none"))
    base = join_dimension(mine, other, ["lang"], "inner").filter(apart).select("lang", "source", "item", (F.col("v") * F.coalesce(empty, F.lit(0).cast("long"))).alias("value"))
    # A source's terms of one share count together against each other source that were to lack them.
    shares = materialise(join_dimension(terms.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")), mine, ["lang", "source"], "inner"), "divergence-shares")
    lacking = join_dimension(shares, other, ["lang"], "inner").filter(apart).select("lang", "source", "item", (F.col("m") * (gap(F.col("p"), F.col("none")) - empty)).alias("value"))
    # Where both have the term, each was counted as lacking once and the start once too often.
    known = join_dimension(terms, mine, ["lang", "source"], "inner").select("lang", "term", "source", "p", "own")
    theirs = known.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("own").alias("none"))
    shared = known.join(theirs, ["lang", "term"]).filter(F.col("source") < F.col("item")).select(
        "lang", "source", "item", (gap(F.col("p"), F.col("q")) - gap(F.col("p"), F.col("none")) - gap(F.col("own"), F.col("q")) + empty).alias("value"))
    summed = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (lacking, shared)]
    # Written once, read in both directions.
    once = materialise(summed[0].unionByName(summed[1]), "divergence-corrections")
    back = once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return base.unionByName(once).unionByName(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def radix_top(rows: DataFrame, by: list[str], k: int = TOP, finish: int = FINISH) -> DataFrame:
    """The k rows of each group with the highest ``value`` (long, 0 or more), ties by the UTF-8 bytes of ``item``, with their rank.

    Items are distinct within a group. Each round is one histogram, aggregated
    where the rows are; a group's rows never meet but for those that can still
    be among the first k, at most ``k + finish`` of them.
    """
    rows = materialise(rows.select(*by, "item", "value"), "radix-rows")
    most = rows.agg(F.max("value").alias("m")).first()["m"] or 0
    state, shift = None, -(-max(1, most.bit_length()) // DIGIT_BITS) * DIGIT_BITS

    def narrowed(histogram: DataFrame, order: Column, name: str) -> DataFrame:
        """The digit in which each group's need is met, what is still needed of it, and its rows."""
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        met = histogram.withColumn("above", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).filter((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
        return materialise(met.withColumn("need", F.col("need") - F.col("above")).drop("above"), name)

    while shift:
        shift -= DIGIT_BITS
        live = rows.withColumn("need", F.lit(k).cast("long")) if state is None else join_dimension(
            rows, state.select(*by, "kth", "need"), by, "inner").filter(F.shiftright("value", shift + DIGIT_BITS) == F.col("kth"))
        digits = live.groupBy(*by, "need", F.shiftright("value", shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        state = narrowed(digits, F.desc("digit"), f"radix-{shift}").withColumnRenamed("digit", "kth")
    # Groups without a state have fewer than k rows and keep them all.
    code = F.col("item").cast("binary")
    state, length = state.withColumn("prefix", F.lit(b"")), 0
    while state.filter(F.col("n") > F.greatest("need", F.lit(finish))).limit(1).count():
        length += DIGIT_BYTES
        tied = join_dimension(rows, state.drop("n"), by, "inner").filter((F.col("value") == F.col("kth")) & (F.substring(code, 1, length - DIGIT_BYTES) == F.col("prefix")))
        starts = tied.groupBy(*by, "kth", "need", F.substring(code, 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        state = narrowed(starts, F.asc("prefix"), f"radix-bytes-{length}")
    able = F.col("kth").isNull() | (F.col("value") > F.col("kth")) | (F.col("value") == F.col("kth")) & (F.substring(code, 1, length) <= F.col("prefix"))
    left = join_dimension(rows, state.select(*by, "kth", "prefix"), by).filter(able)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), code))
    return left.select(*by, "item", "value", rank.alias("rank")).filter(F.col("rank") <= k)


def divergence(docs: DataFrame, top: int = TOP, finish: int = FINISH) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of every group."""
    found, groups = kept_terms(docs)
    found = join_dimension(found, groups.select("lang", "source", "total", "lang_total"), ["lang", "source"], "inner")
    found = materialise(found.select("lang", "source", "term", share(F.col("count"), F.col("total")).alias("p"), share(F.col("lang_count"), F.col("lang_total")).alias("q")), "divergence-shares")
    telling = radix_top(found.filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")), ["lang", "source"], top, finish)
    pairs = pair_values(found.drop("q"), groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item").cast("binary")))
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(telling.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
    return both.withColumn("rank", F.col("rank").cast("int"))


def divergence_sql() -> str:
    """The whole sums over all kept terms, without the sparse form; by DuckDB."""
    p = lambda c, n: f"1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * v)"
    f = "((p - q) * (p - q)) // (p + q)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS ln FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN l USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS gn FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, l.term, coalesce(c.n, 0) AS n, {p('coalesce(c.n, 0)', 'gn')} AS p, {p('l.n', 'ln')} AS q
      FROM s JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = l.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum({f.replace('p', 'a.p').replace('q', 'b.p')}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ({f})::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= {TOP}"""
