"""Validation by asset: ranges of missing days, days that related tables lack, null and neutral fields.

Defined cases: rows without an asset or day are left out; repeated rows count once; an asset without bars misses all of its
days, one that is listed after the last day has none to miss; without trading days there is nothing to report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ISSUE = ["asset_id", "issue", "source", "field"]


def ranges(assets: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """asset_id, gap_start, gap_end, missing: runs of trading days from ``list_date`` (asset_id, list_date) on without a bar.

    Runs before the first and after the last bar count too.  Trading days are numbered once, and a listing's number is looked
    up by its date, so that no asset is set against all days.
    """
    order = Window.orderBy("d")  # one row a day
    number = days.where("d is not null").select("d").distinct().withColumn("no", F.row_number().over(order))
    span = number.agg(F.min("d").alias("a"), F.max("d").alias("z"), F.max("no").alias("last"))
    every = span.where("a is not null").select("a", "z", "last", F.explode(F.sequence("a", "z")).alias("d"))
    every = every.join(number, "d", "left").withColumn("start", F.coalesce(F.min("no").over(order.rowsBetween(0, Window.unboundedFollowing)), F.col("last")))
    first = F.greatest(F.coalesce("list_date", "a"), F.col("a"))
    listed = assets.where("asset_id is not null").groupBy("asset_id").agg(F.min("list_date").alias("list_date")).crossJoin(F.broadcast(span))  # one row of scalars
    listed = listed.withColumn("d", first).join(every.select("d", "start"), "d").select("asset_id", "start", "last")
    held = bars.where("asset_id is not null and d is not null").select("asset_id", "d").distinct().join(number, "d").select("asset_id", "no")
    held = held.join(listed, "asset_id").where("no >= start").select("asset_id", "no")
    ends = listed.select("asset_id", F.explode(F.array(F.col("start") - 1, F.col("last") + 1)).alias("no"))
    steps = held.unionByName(ends).withColumn("next", F.lead("no").over(Window.partitionBy("asset_id").orderBy("no"))).where("next - no > 1")
    a, z = number.select(F.col("d").alias("gap_start"), F.col("no").alias("a")), number.select(F.col("d").alias("gap_end"), F.col("no").alias("z"))
    out = steps.join(a, F.col("a") == F.col("no") + 1).join(z, F.col("z") == F.col("next") - 1)
    return out.select("asset_id", "gap_start", "gap_end", (F.col("next") - F.col("no") - 1).cast("long").alias("missing"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ISSUE).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


def missing_related(bars: DataFrame, related: dict[str, DataFrame], parts: int | None = None) -> DataFrame:
    """Issues of asset and source: days with a bar for which a related table (asset_id, d) has no row; one shuffle for all.

    The shuffle has ``parts`` partitions, if given; what is kept of a day is a flag a table.
    """
    x = bars.select("asset_id", "d", F.lit(None).cast("string").alias("source"))
    for name, rows in related.items():
        x = x.unionByName(rows.select("asset_id", "d", F.lit(name).alias("source")))
    x = _dealt(x.where("asset_id is not null and d is not null"), parts)
    have = {name: F.max(F.when(F.col("source") == name, True)) for name in related}
    x = x.groupBy("asset_id", "d").agg(F.max(F.col("source").isNull()).alias("traded"), *[v.alias(f"have_{k}") for k, v in enumerate(have.values())])
    lacking = F.filter(F.array(*[F.when(F.col(f"have_{k}").isNull(), F.lit(name)) for k, name in enumerate(have)]), lambda s: s.isNotNull())
    x = x.where("traded").select("asset_id", "d", F.explode(lacking).alias("source"))
    return _counted(x.select("asset_id", F.lit("missing_related").alias("issue"), "source", F.lit("").alias("field"), "d"))


def _dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    return rows if parts is None else rows.repartition(parts, "asset_id", "d")


def fields(rows: DataFrame, source: str, nulls: list[str] = [], neutral: list[str] = [], value: float = 0.5, parts: int | None = None) -> DataFrame:  # noqa: B006
    """Issues of asset and field of one table: nulls, and values that equal the ``neutral`` default; the table is read once.

    Only rows that have an issue are told apart from their copies, in a shuffle of ``parts`` partitions, if given.
    """
    found = [F.when(F.col(c).isNull(), F.struct(F.lit("null_field").alias("issue"), F.lit(c).alias("field"))) for c in nulls]
    found += [F.when(F.col(c) == value, F.struct(F.lit("neutral_default").alias("issue"), F.lit(c).alias("field"))) for c in neutral]
    x = rows.where("asset_id is not null and d is not null")
    issues = F.filter(F.array(*found), lambda f: f.isNotNull())
    x = x.select("asset_id", "d", *dict.fromkeys([*nulls, *neutral])).where(F.size(issues) > 0)
    x = _dealt(x, parts).distinct().select("asset_id", "d", F.explode(issues).alias("f"))
    return _counted(x.select("asset_id", "f.issue", F.lit(source).alias("source"), "f.field", "d"))
