"""Parameter trials as data: one plan for any number of parameter sets.

Stored indicators and the evaluation's frames are the same for all sets and are
made once; then candles meet the table of sets, and gates, detectors, exits and
occupancy read their parameters from the row. Each set runs a walk-forward of
its own on every series and is compared with the baseline out of sample.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickflow.operators import backtest, metrics
from wickflow.operators.signals import judge, with_frames
from wickflow.params import NAMES, ColumnParams, Params
from wickflow.schemas import SERIES
from wickflow.scratch import materialise

#: Fewest candles of a series for which a change is judged at all.
LEAST_CANDLES = 100
BASELINE = "baseline"


def table(spark: SparkSession, sets: Mapping[str, Params]) -> DataFrame:
    """A row per set: its name and a column per parameter. Sets are written by hand: the table is tiny."""
    rows = [(name, *(float(getattr(p, n)) if isinstance(getattr(Params(), n), float) else getattr(p, n) for n in NAMES)) for name, p in sets.items()]
    return spark.createDataFrame(rows, ", ".join(["trial string", *(f"p_{n} {'double' if isinstance(getattr(Params(), n), float) else 'int'}" for n in NAMES)]))


def run(enriched: DataFrame, sets: Mapping[str, Params], train: float = 0.6, **options) -> DataFrame:
    """The walk-forward of every set on every series, as ``backtest.simulate`` returns it, keyed by ``trial`` too."""
    params = ColumnParams(tuple(sets.values()))
    framed = with_frames(backtest.fold_split(enriched, train), params)
    each = framed.crossJoin(F.broadcast(table(enriched.sparkSession, sets)))
    return backtest.simulate(judge(each, params), params, **options)


def judge_trials(enriched: DataFrame, sets: Mapping[str, Params], threshold: float = 0.05, **options) -> DataFrame:
    """Per series, trial and metric: baseline and candidate out of sample, result, the trial's verdict and the set that is kept.

    ``sets`` holds one under ``baseline``. An accepted trial is kept, a rejected
    one goes back to the baseline. So does any trial of a series with fewer than
    ``LEAST_CANDLES`` candles: its verdict is INSUFFICIENT, values are null.
    """
    if BASELINE not in sets:
        raise ValueError("one set must be the baseline")
    enriched = materialise(enriched, "trial-candles")
    counts = enriched.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    enough = counts.filter(F.col("n") >= LEAST_CANDLES).drop("n")
    ran = run(enriched.join(enough, list(SERIES), "left_semi"), sets, **options)
    by = [*SERIES, "trial"]
    out_sample = ran.filter("fold = 'out_sample'")
    # Series that are shorter than the warm-up trade nothing and still have their row of zeros.
    groups = enough.withColumn("trial", F.explode(F.array(*map(F.lit, sets))))
    found = materialise(metrics.summary(backtest.trades(out_sample), by, ["exit_ts", "entry_ts"], groups), "trial-metrics")
    candidates = found.filter(F.col("trial") != BASELINE)
    base = found.filter(F.col("trial") == BASELINE).drop("trial").join(candidates.select(*by), list(SERIES))
    judged = metrics.compare(base, candidates, by, threshold).withColumn("kept", F.when(F.col("verdict") == "ACCEPT", F.col("trial")).otherwise(BASELINE))
    names = F.explode(F.array(*[F.struct(F.lit(t).alias("trial"), F.lit(m).alias("metric")) for t in sets if t != BASELINE for m in metrics.COMPARED]))
    none = F.lit(None)
    few = counts.filter(F.col("n") < LEAST_CANDLES).select(*SERIES, names.alias("x")).select(
        *SERIES, "x.trial", "x.metric", none.cast("double").alias("baseline"), none.cast("double").alias("candidate"), none.cast("string").alias("result"), F.lit("INSUFFICIENT").alias("verdict"), F.lit(BASELINE).alias("kept"))
    return judged.unionByName(few)
