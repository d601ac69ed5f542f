"""Universes over time: versions of memberships, the difference that a snapshot makes, and what new members still lack.

A snapshot holds all members of an index on a day: index_code, trade_date, asset_id, weight.  A version is a span of days in
which an asset's membership and weight stayed the same: valid_from, and valid_to or null while it is open.  A table of
versions has at most one open version an index and asset, and no two that adjoin with equal weights.

Defined cases: rows with a null key are left out; of repeated rows the greatest weight counts; null weights are equal; an
index that a snapshot does not hold, or holds a day of that is older than the newest change of its versions, is not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["index_code", "asset_id"]
VERSION = [*KEYS, "weight", "valid_from", "valid_to"]


def _members(snapshots: DataFrame) -> DataFrame:
    known = snapshots.where("index_code is not null and trade_date is not null and asset_id is not null")
    return known.groupBy("index_code", "trade_date", "asset_id").agg(F.max("weight").alias("weight"))


def versions(snapshots: DataFrame) -> DataFrame:
    """The versions of a whole history of snapshots: a member is one until the index's next snapshot says otherwise."""
    x = _members(snapshots)
    order = Window.partitionBy("index_code").orderBy("trade_date")  # one row a snapshot
    days = x.select("index_code", "trade_date").distinct()
    days = days.withColumns({"no": F.row_number().over(order), "following": F.lead("trade_date").over(order)})
    by = Window.partitionBy(*KEYS).orderBy("trade_date")
    x = x.join(days, ["index_code", "trade_date"])
    begins = F.coalesce(F.lag("no").over(by) != F.col("no") - 1, F.lit(True)) | ~F.lag("weight").over(by).eqNullSafe(F.col("weight"))
    x = x.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(by))
    out = x.groupBy(*KEYS, "span").agg(F.max("weight").alias("weight"), F.min("trade_date").alias("valid_from"), F.max_by("following", "trade_date").alias("following"))
    return out.select(*KEYS, "weight", "valid_from", F.date_sub("following", 1).alias("valid_to"))


def diff(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """index_code, asset_id, change, old_weight, weight, as_of: members that a snapshot opens, closes or changes.

    ``snapshot`` has one day an index (its newest, if there are more).  Members that stay as they are have no row.
    """
    new = _members(snapshot)
    day = new.groupBy("index_code").agg(F.max("trade_date").alias("as_of"))  # one row an index
    touched = stored.groupBy("index_code").agg(F.max(F.greatest("valid_from", F.date_add("valid_to", 1))).alias("touched"))
    day = day.join(touched, "index_code", "left").where("touched is null or touched <= as_of").select("index_code", "as_of")
    new = new.join(day, "index_code").where("trade_date = as_of").select(*KEYS, "weight", F.lit(True).alias("now"))
    old = stored.where("valid_to is null").select(*KEYS, F.col("weight").alias("old_weight"), F.lit(True).alias("before"))
    change = F.when(F.col("before").isNull(), "opened").when(F.col("now").isNull(), "closed").when(~F.col("old_weight").eqNullSafe(F.col("weight")), "changed")
    x = old.join(new, KEYS, "full").withColumn("change", change).where("change is not null")
    return x.join(day, "index_code").select(*KEYS, "change", "old_weight", "weight", "as_of")


def applied(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The versions after ``changes``; a second snapshot of one day corrects the first, and the same one changes nothing."""
    ended = changes.where("change in ('closed', 'changed')").select(*KEYS, F.col("as_of").alias("at"))
    x = stored.select(*VERSION).join(ended, KEYS, "left")
    ends = F.col("at").isNotNull() & F.col("valid_to").isNull()
    x = x.where(~(ends & (F.col("valid_from") >= F.col("at")))).withColumn("valid_to", F.when(ends, F.date_sub("at", 1)).otherwise(F.col("valid_to")))
    begun = changes.where("change in ('opened', 'changed')").select(*KEYS, "weight", F.col("as_of").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return _joined(x.select(*VERSION).unionByName(begun))


def _joined(x: DataFrame) -> DataFrame:
    """Adjoining versions of equal weight as one, as a corrected day leaves them."""
    by = Window.partitionBy(*KEYS).orderBy("valid_from")
    begins = F.coalesce(F.date_add(F.lag("valid_to").over(by), 1) != F.col("valid_from"), F.lit(True)) | ~F.lag("weight").over(by).eqNullSafe(F.col("weight"))
    x = x.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(by))
    return x.groupBy(*KEYS, "span").agg(F.max("weight").alias("weight"), F.min("valid_from").alias("valid_from"), F.max_by("valid_to", "valid_from").alias("valid_to")).select(*VERSION)


def newcomers(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """asset_id, as_of: assets that an index opens while no index held them, by the versions before ``changes``."""
    opened = changes.where("change = 'opened'").groupBy("asset_id").agg(F.min("as_of").alias("as_of"))
    return opened.join(stored.where("valid_to is null").select("asset_id"), "asset_id", "left_anti")


def worklist(assets: DataFrame, wanted: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """asset_id, source, wanted, stored, first_d, last_d: what each of ``assets`` lacks in each table, complete ones left out.

    ``wanted`` has source and d, the days that a table should hold for every asset; ``stored`` is a table by source, of
    asset_id and d.  Days that nobody wants do not count.  Each table is read once, for the assets' rows only.
    """
    due = wanted.where("d is not null").groupBy("source").agg(F.countDistinct("d").alias("wanted"))  # one row a source
    keys = assets.select("asset_id").dropna().distinct()
    have = None
    for name, rows in stored.items():
        part = rows.select("asset_id", "d").join(keys, "asset_id", "left_semi").select("asset_id", F.lit(name).alias("source"), "d")
        have = part if have is None else have.unionByName(part)
    have = have.distinct().join(wanted.select("source", "d").distinct(), ["source", "d"], "left_semi")
    counts = have.groupBy("asset_id", "source").agg(F.count("d").alias("stored"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    each = keys.withColumn("source", F.explode(F.array(*map(F.lit, stored)))).join(due, "source")
    x = each.join(counts, ["asset_id", "source"], "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))
    return x.where("stored < wanted").select("asset_id", "source", "wanted", "stored", "first_d", "last_d")
