"""Curves side by side: series with calendars of their own, on the days of one of them and from a common base.

``members`` has comparison_id, series and selected (true for the one series whose days count); ``curves`` has series, d and
value.  Any number of comparisons is worked out at once: the grid of a comparison is an equality join of its days with its
members, which has the size of the result, and a window holds one series of one comparison.

Defined cases: points without a day or value are left out; of several points of a day the greatest counts; a member whose
points all lie after the selected series' last day, or that is 0 on the base day, has no rows; a comparison whose selected
series has no points has none at all; other columns of either table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["comparison_id", "series"]


def _points(members: DataFrame, curves: DataFrame) -> tuple[DataFrame, DataFrame]:
    roles = members.where("comparison_id is not null and series is not null").groupBy(*KEYS).agg(F.max(F.coalesce("selected", F.lit(False))).alias("selected"))
    daily = curves.where("d is not null and value is not null").groupBy("series", "d").agg(F.max("value").alias("value"))
    return roles, roles.join(daily, "series")


def bases(members: DataFrame, curves: DataFrame) -> DataFrame:
    """comparison_id, base_d, level: the selected series' first day on which every member has a value, and its value then."""
    _, points = _points(members, curves)
    first = points.groupBy(*KEYS).agg(F.min("d").alias("first"))
    days = points.where("selected").select("comparison_id", "d", F.col("value").alias("level"))
    last = days.groupBy("comparison_id").agg(F.max("d").alias("last"))
    start = first.join(last, "comparison_id").where("first <= last").groupBy("comparison_id").agg(F.max("first").alias("start"))
    return days.join(start, "comparison_id").where("d >= start").groupBy("comparison_id").agg(F.min("d").alias("base_d"), F.min_by("level", "d").alias("level"))


def compared(members: DataFrame, curves: DataFrame) -> DataFrame:
    """comparison_id, series, d, value, drawdown from the base day on.

    Each member has its last value on or before each of the selected series' days, scaled so that all are equal on the base
    day; the drawdown is against the greatest value since then.
    """
    roles, points = _points(members, curves)
    base = bases(members, curves)
    days = points.where("selected").join(base, "comparison_id").where("d >= base_d").select("comparison_id", "d", "level")
    grid = roles.drop("selected").join(days, "comparison_id").withColumn("asked", F.lit(True))
    known = points.select(*KEYS, "d", F.col("value").cast("double").alias("value"), F.lit(False).alias("asked"))
    by = Window.partitionBy(*KEYS)
    so_far = by.orderBy("d", "asked").rowsBetween(Window.unboundedPreceding, 0)
    x = known.unionByName(grid, allowMissingColumns=True).withColumn("value", F.last("value", True).over(so_far))
    x = x.where("asked and value is not null")
    since = by.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("at", F.first("value").over(since)).where("at <> 0")
    x = x.select(*KEYS, "d", (F.col("value") * F.col("level") / F.col("at")).alias("value"))
    return x.withColumn("drawdown", F.col("value") / F.max("value").over(since) - 1)


def summary(rows: DataFrame) -> DataFrame:
    """Of ``compared`` rows, a row a series: its days, first and last, total return and greatest drawdown (0 or less)."""
    out = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("days"), F.min("d").alias("first_d"), F.max("d").alias("last_d"),
        F.min_by("value", "d").alias("a"), F.max_by("value", "d").alias("z"), F.min("drawdown").alias("max_drawdown"),
    )
    return out.select(*KEYS, "days", "first_d", "last_d", (F.col("z") / F.col("a") - 1).alias("total_return"), "max_drawdown")
