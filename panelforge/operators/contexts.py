"""Repair of closed intervals: months that come late, change or go reopen only the intervals that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import phase

KEPT = ("starts_at", "ends_at", "phase", "is_active")


def history(months: DataFrame) -> DataFrame:
    """starts_at, ends_at, phase, is_active: an interval from each month with a purchasing index to the day before the next.

    ``months`` has date, pmi, non_pmi and cpi10, one row a month; the last interval is open and the active one.
    """
    order = Window.orderBy("date")  # one row a month
    x = months.where("pmi is not null")
    x = x.withColumns({"slope": F.col("pmi") - F.lag("pmi").over(order), "following": F.lead("date").over(order)})
    return x.select(
        F.col("date").alias("starts_at"),
        F.date_sub("following", 1).alias("ends_at"),
        phase(F.col("pmi"), F.col("slope"), F.col("non_pmi"), F.col("cpi10") / 10.0).alias("phase"),
        F.col("following").isNull().alias("is_active"),
    )


def _around(months: DataFrame, stored: DataFrame, changed: DataFrame) -> DataFrame:
    """starts_at: the changed months, and of the others the last before and the first after each, by old and new intervals.

    The one before may end otherwise, the one after have another slope; no other interval depends on a changed month.
    """
    dates = months.where("pmi is not null").select("date").union(stored.select("starts_at")).union(changed.select("date")).distinct()
    # one row a month: which neighbours are changed, whatever changed ones lie between
    marked = dates.join(changed.select("date", F.lit(True).alias("hit")).distinct(), "date", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    order = Window.orderBy("date")
    near = F.coalesce(F.lag("hit").over(order), F.lit(False)) | F.coalesce(F.lead("hit").over(order), F.lit(False))
    return marked.withColumn("near", near).where("hit or near").select(F.col("date").alias("starts_at"))


def differs(a: dict[str, Column], b: dict[str, Column]) -> Column:
    out = F.lit(False)
    for name in a:
        out = out | ~a[name].eqNullSafe(b[name])
    return out


def patch(stored: DataFrame, months: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows to write, with ``change``: upsert, or delete where a month has gone; rows that stay are not among them.

    ``months`` is the macro table after the upsert of the months ``changed`` (date).
    """
    around = _around(months, stored, changed)
    fresh = history(months).join(F.broadcast(around), "starts_at", "left_semi").select(*[F.col(c).alias(f"new_{c}") for c in KEPT])
    old = stored.join(F.broadcast(around), "starts_at", "left_semi").select(*KEPT)
    both = old.join(fresh, old["starts_at"] == fresh["new_starts_at"], "full")
    gone = F.col("new_starts_at").isNull()
    new = {c: F.when(gone, F.col(c)).otherwise(F.col(f"new_{c}")) for c in KEPT}
    moved = differs({c: F.col(c) for c in KEPT}, {c: F.col(f"new_{c}") for c in KEPT})
    return both.where(moved).select(*[new[c].alias(c) for c in KEPT], F.when(gone, "delete").otherwise("upsert").alias("change"))


def applied(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored intervals after a patch."""
    kept = stored.select(*KEPT).join(F.broadcast(changes.select("starts_at")), "starts_at", "left_anti").select(*KEPT)
    return kept.unionByName(changes.where("change = 'upsert'").select(*KEPT))
