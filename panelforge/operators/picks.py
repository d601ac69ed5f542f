"""Candidates of backtest runs: every run picks by its own strategy, source, scope and cut, all runs at once.

``runs`` has run_id, strategy (``bottom`` or ``prediction``), mode (``top_n`` or ``trade_score``), metric (``up`` or
``trade_score``, for top_n), scope (``independent`` or ``combined``), source, horizon, up_threshold, threshold, top_n,
max_positions and macro.  ``scores`` has source, horizon, asset_id, d, up and trade_score, one row a key.

Defined cases: a score that a run needs and that is null, or a run of an unknown strategy or mode, gives no candidate; ties
go to the smaller asset; a day without a phase leaves values as they are; cuts of 0 or less pick nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import four
from .scoring import macro_multiplier

SCORE = ["source", "horizon", "asset_id", "d", "up", "trade_score"]
FACTOR, COMBINED = "factor", "combined"


def factor_rows(factors: DataFrame) -> DataFrame:
    """Factor scores as scores of the source ``factor``, whose trade score is the bottom probability."""
    return factors.select(F.lit(FACTOR).alias("source"), F.lit(0).alias("horizon"), "asset_id", "d", F.lit(None).cast("double").alias("up"), F.col("bottom").alias("trade_score"))


def combined(scores: DataFrame) -> DataFrame:
    """Scores of the source ``combined``: means over the sources that have a value, from exact sums of four places."""

    def mean(name: str) -> Column:
        return (F.sum(F.floor(F.col(name) * 10000 + 0.5).cast("long")) / (F.count(name) * 10000.0)).alias(name)

    return scores.groupBy("asset_id", "d", "horizon").agg(mean("up"), mean("trade_score")).withColumn("source", F.lit(COMBINED)).select(*SCORE)


def combined_value(*values: Column) -> Column:
    """The mean that ``combined`` has, of the sources' values of one row."""
    whole = [F.floor(v * 10000 + 0.5).cast("long") for v in values]
    known = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(known > 0, sum((F.coalesce(w, F.lit(0)) for w in whole), F.lit(0).cast("long")) / (known * 10000.0))


def picked(runs: DataFrame, scores: DataFrame, phases: DataFrame, most: int | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """run_id, d, rank, asset_id, value: the candidates of every run and day, best first.

    ``scores`` holds every source that a run may name, with ``factor_rows`` and ``combined``; ``phases`` has month and phase.
    A run with ``macro`` multiplies the values of its first cut by the phase's factor and orders them again.  ``most`` is the
    largest cut of all runs, if known: the limit is then applied before the shuffle.  ``eligible`` (asset_id, d) restricts.
    """
    bottom, trade = F.col("strategy") == "bottom", F.col("mode") == "trade_score"
    known = bottom | ((F.col("strategy") == "prediction") & F.col("mode").isin("top_n", "trade_score"))
    r = runs.where(known).select(
        "run_id", "up_threshold", "threshold", (bottom | trade).alias("bounded"), (~bottom).alias("likely"),
        (bottom | trade | (F.coalesce("metric", F.lit("up")) == "trade_score")).alias("by_trade"),
        F.when(bottom, FACTOR).when(trade & (F.col("scope") == COMBINED), COMBINED).otherwise(F.col("source")).alias("source"),
        F.when(bottom, 0).otherwise(F.col("horizon")).alias("horizon"),
        F.when(~bottom & trade, F.col("max_positions")).otherwise(F.col("top_n")).alias("cut"), (~bottom & F.coalesce("macro", F.lit(False))).alias("macro"),
    )
    rows = scores.select(*SCORE)
    if eligible is not None:
        rows = rows.join(eligible.select("asset_id", "d").distinct(), ["asset_id", "d"], "left_semi")
    x = rows.join(r, ["source", "horizon"]).where("(not likely or up >= up_threshold) and (not bounded or trade_score >= threshold)")
    x = x.withColumn("value", F.when(F.col("by_trade"), F.col("trade_score")).otherwise(F.col("up"))).where("value is not null")

    def cut(y: DataFrame) -> DataFrame:
        y = y.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "d").orderBy(F.desc("value"), "asset_id")))
        return (y if most is None else y.where(F.col("rank") <= most)).where("rank <= cut")

    first = cut(x).withColumn("month", F.trunc("d", "MM")).join(phases.select("month", "phase"), "month", "left")
    factor = F.when(F.col("macro"), macro_multiplier(F.col("phase"), F.col("up"))).otherwise(1.0)
    return cut(first.withColumn("value", four(F.col("value") * factor))).select("run_id", "d", "rank", "asset_id", "value")
