"""Ranks across the assets of a day, index values, and series over the market's days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_asset, four
from .pointintime import asof, day_pairs, members_on


def percentile(x: str, *keys: str) -> Column:
    """Share of the group's non-null values that are at most this one; null for null."""
    group = Window.partitionBy(*keys)
    ranked = F.cume_dist().over(group.orderBy(F.col(x).asc_nulls_last()))
    rows, known = F.count(F.lit(1)).over(group), F.count(x).over(group)
    # nulls come last, so a known value's rank among all rows is its rank among the known
    return F.when(F.col(x).isNotNull(), F.round(ranked * rows) / known)


def percentiles(x: DataFrame, key: str, *columns: str) -> DataFrame:
    """``percentile`` of several columns over the same groups, each in place of its column under the name with _rank; counts are one pass."""
    group = Window.partitionBy(key)
    x = x.withColumns({f"_known_{c}": F.count(c).over(group) for c in columns})
    for c in columns:
        ranked = F.count(c).over(group.orderBy(F.col(c).asc_nulls_last()))  # of equal values all are counted
        x = x.withColumn(f"{c}_rank", F.when(F.col(c).isNotNull(), ranked / F.col(f"_known_{c}"))).drop(c, f"_known_{c}")
    return x


def rs_score(bars: DataFrame, n: int = 20, top: float = 0.2) -> DataFrame:
    """Rank of the n-row return on each day: score 1 - (rank - 1) / assets, and the leading fifth flagged."""
    back = F.lag("c", n).over(by_asset())
    moved = bars.select("asset_id", "d", ((F.col("c") - back) * 1.0 / back).alias("ret")).where("ret is not null")
    out = moved.withColumns(dict(zip(("rank", "n"), day_rank("ret"), strict=True)))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * top))
    return out.select("asset_id", "d", "rank", four(1 - (F.col("rank") - 1) / F.col("n")).alias("rs_score"), (F.col("rank") <= cut).alias("leads"))


def day_rank(x: str) -> tuple[Column, Column]:
    """Place of a row among its day's rows by ``x``, the greatest first, ties by asset; and how many have an ``x`` (nulls come last)."""
    day = Window.partitionBy("d")
    return F.row_number().over(day.orderBy(F.desc_nulls_last(x), "asset_id")), F.count(x).over(day)


def weighted_returns(bars: DataFrame, members: DataFrame, shares: DataFrame) -> DataFrame:
    """d, ret (capitalization-weighted), n, overlap: members of a day, from the market's previous close to the day's.

    Weights are the newest known free shares times the day's close; an asset without both closes is left out.
    """
    days = bars.select("d").distinct()
    on = members_on(days, members)
    now = bars.select("asset_id", "d", "c").join(day_pairs(days), "d")
    before = bars.select("asset_id", F.col("d").alias("prev_d"), F.col("c").alias("prev_c"))
    now = now.join(before, ["asset_id", "prev_d"]).join(on, ["d", "asset_id"])
    now = asof(now.select("asset_id", "d", "c", "prev_c", "overlap"), shares.select("asset_id", "available_date", "free_share"), "asset_id", "d", "available_date", "free_share")
    weight = F.coalesce("free_share", F.lit(1)) * F.col("c")
    # basis points of a return, so that sums are exact
    bp = F.floor((F.col("c") - F.col("prev_c")) * 10000.0 / F.col("prev_c") + 0.5).cast("long")
    day = now.groupBy("d").agg(F.sum(weight * bp).alias("wr"), F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"), F.count_if("overlap").alias("overlap"))
    return day.select("d", (F.col("wr") / F.col("w").cast("double")).alias("ret_bp"), "n", "overlap")


def nav(returns: DataFrame, start: float = 100000.0) -> DataFrame:
    """Cumulative value of daily returns in basis points: one row a trading day, so one ordered window."""
    grown = F.exp(F.sum(F.log1p(F.col("ret_bp") / 10000.0)).over(Window.orderBy("d")))
    return returns.select("d", "ret_bp", (grown * start).alias("nav"))


def drawdown(series: DataFrame, value: str) -> DataFrame:
    """Running peak and the relative fall from it."""
    peak = F.max(value).over(Window.orderBy("d"))
    return series.withColumn("peak", peak).withColumn("drawdown", four(F.col(value) / F.col("peak") - 1))


def equal_weight(bars: DataFrame) -> DataFrame:
    """Mean one-row return of the assets of each day, in basis points."""
    back = F.lag("c").over(by_asset())
    bp = F.floor((F.col("c") - back) * 10000.0 / back + 0.5).cast("long")
    day = bars.select("d", bp.alias("bp")).where("bp is not null").groupBy("d").agg(F.sum("bp").alias("s"), F.count(F.lit(1)).alias("n"))
    return day.select("d", (F.col("s") / F.col("n").cast("double")).alias("ret_bp"), "n")
