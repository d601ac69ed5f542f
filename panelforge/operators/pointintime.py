"""Time-aware joins: as-of, next row, interval containment, snapshot membership, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, on: str, right_on: str, *columns: str) -> DataFrame:
    """``left`` with the ``columns`` of the newest row of ``right`` at or before ``on``, by ``key``.

    A union and a running last value: one shuffle on the key and one sort, no range join.
    """
    return asof_each(left, key, on, (right, right_on, columns))


def asof_each(left: DataFrame, key: str, on: str, *sides: tuple[DataFrame, str, tuple[str, ...]], parts: int | None = None) -> DataFrame:
    """``left`` with columns of the newest rows of several tables, each given as (table, its time, its columns).

    All sides go through one shuffle and one sort.  With ``parts``, each side is dealt by the key to so many partitions, and one
    that lies so is not shuffled again.  The key stays a column of its own, so windows over it that follow find the rows where
    they are.
    """
    width = len(sides)
    kept = [c for c in left.columns if c not in (key, on)]
    packed = [F.struct(*[F.col(c) for c in columns]) for _, _, columns in sides]
    kinds = [right.select(x.alias("x")).schema["x"].dataType for (right, _, _), x in zip(sides, packed, strict=True)]
    rest = F.struct(F.lit(width).alias("_side"), *kept)
    kind = left.select(rest.alias("x")).schema["x"].dataType
    nothing = [F.lit(None).cast(k).alias(f"_right{n}") for n, k in enumerate(kinds)]
    dealt = lambda x: x if parts is None else x.repartition(parts, key)
    both = dealt(left).select(F.col(key), F.col(on).alias("_t"), F.lit(width).alias("_side"), rest.alias("_left"), *nothing)
    for n, ((right, right_on, _), x) in enumerate(zip(sides, packed, strict=True)):
        own = [x.alias(f"_right{n}") if m == n else y for m, y in enumerate(nothing)]
        both = both.unionByName(dealt(right).select(F.col(key), F.col(right_on).alias("_t"), F.lit(n).alias("_side"), F.lit(None).cast(kind).alias("_left"), *own))
    seen = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({f"_right{n}": F.last(f"_right{n}", ignorenulls=True).over(seen) for n in range(width)}).where(F.col("_side") == width)
    found = {key: F.col(key), on: F.col("_t").cast(left.schema[on].dataType).alias(on)}
    return both.select(*[found.get(c, F.col(f"_left.{c}").alias(c)) for c in left.columns], *[F.col(f"_right{n}.{c}").alias(c) for n, (_, _, columns) in enumerate(sides) for c in columns])


def latest(df: DataFrame, key: str, on: str) -> DataFrame:
    """The newest row of each key, by partial aggregation."""
    row = F.max_by(F.struct(*df.columns), F.col(on)).alias("_r")
    return df.groupBy(key).agg(row).select("_r.*")


def next_row(bars: DataFrame, days: int, slack: int = 7) -> DataFrame:
    """Adds exit_d and exit_c: the first bar at least ``days`` calendar days later, within ``slack`` more."""
    day = F.datediff("d", F.lit("1970-01-01"))
    ahead = Window.partitionBy("asset_id").orderBy(day).rangeBetween(days, days + slack)
    hit = F.first(F.struct("d", "c")).over(ahead)
    return bars.withColumn("_hit", hit).withColumns({"exit_d": F.col("_hit.d"), "exit_c": F.col("_hit.c")}).drop("_hit")


def snapshot_intervals(members: DataFrame) -> DataFrame:
    """index_code, trade_date, valid_to (the day before the next snapshot, or null); one row a snapshot."""
    shots = members.select("index_code", "trade_date").distinct()
    following = F.lead("trade_date").over(Window.partitionBy("index_code").orderBy("trade_date"))
    return shots.withColumn("valid_to", F.date_sub(following, 1))


def members_on(days: DataFrame, members: DataFrame) -> DataFrame:
    """d, asset_id, indexes (sorted), overlap: the union of every index's newest snapshot at or before each day.

    The newest snapshot of each index and day comes from an as-of join on the index, so days meet snapshots
    by equality and no range join is needed.
    """
    codes = members.select("index_code").distinct()
    grid = days.crossJoin(F.broadcast(codes))  # a few index codes
    shots = snapshot_intervals(members).select("index_code", "trade_date")
    at = asof(grid, shots.withColumnRenamed("trade_date", "snapshot"), "index_code", "d", "snapshot", "snapshot").where("snapshot is not null")
    each = at.join(members, (at["index_code"] == members["index_code"]) & (at["snapshot"] == members["trade_date"])).select("d", "asset_id", at["index_code"])
    return each.groupBy("d", "asset_id").agg(F.array_sort(F.collect_set("index_code")).alias("indexes")).withColumn("overlap", F.size("indexes") > 1)


def containing(days: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each day with the newest interval (starts_at, ends_at, label) that holds it, or the newest started before.

    ``intervals`` has at most a row a month: it is broadcast, and each day keeps one row.
    """
    at = days.join(F.broadcast(intervals), F.col("starts_at") <= F.col("d"), "left")
    inside = F.col("ends_at").isNull() | (F.col("ends_at") >= F.col("d"))
    best = F.max(F.when(F.col("starts_at").isNotNull(), F.struct(inside.alias("inside"), "starts_at", "label")))
    return at.groupBy("d").agg(best.alias("b")).select("d", F.col("b.label").alias("label"), F.coalesce("b.inside", F.lit(False)).alias("inside"))


def coverage(days: DataFrame, intervals: DataFrame) -> DataFrame:
    """Number of intervals that hold each day: 0 is a hole, more than 1 an overlap."""
    inside = (F.col("starts_at") <= F.col("d")) & (F.col("ends_at").isNull() | (F.col("ends_at") >= F.col("d")))
    held = days.join(F.broadcast(intervals), inside, "left")
    return held.groupBy("d").agg(F.count("starts_at").alias("n"))


def gaps(panel: DataFrame, days: DataFrame) -> DataFrame:
    """asset_id, gap_start, gap_end, missing: runs of trading days without a bar, between an asset's first and last.

    Days are numbered once; a gap is a step of more than one between neighbouring bars.
    """
    number = days.select("d", F.row_number().over(Window.orderBy("d")).alias("no"))  # one row a trading day
    by = Window.partitionBy("asset_id").orderBy("no")
    steps = panel.select("asset_id", "d").join(F.broadcast(number), "d").withColumn("next", F.lead("no").over(by))
    holes = steps.where("next - no > 1")
    first, last = number.select(F.col("d").alias("gap_start"), F.col("no").alias("a")), number.select(F.col("d").alias("gap_end"), F.col("no").alias("b"))
    out = holes.join(F.broadcast(first), F.col("a") == F.col("no") + 1).join(F.broadcast(last), F.col("b") == F.col("next") - 1)
    return out.select("asset_id", "gap_start", "gap_end", (F.col("next") - F.col("no") - 1).cast("long").alias("missing"))


def closed_intervals(starts: DataFrame) -> DataFrame:
    """starts_at, label, ends_at (the day before the next start); of equal starts the larger label stays."""
    one = starts.groupBy("starts_at").agg(F.max("label").alias("label"))
    return one.withColumn("ends_at", F.date_sub(F.lead("starts_at").over(Window.orderBy("starts_at")), 1))  # one row a month


def day_pairs(days: DataFrame) -> DataFrame:
    """Each trading day with the market's previous one."""
    return days.select("d", F.lag("d").over(Window.orderBy("d")).alias("prev_d"))  # one row a trading day


def newest_first(order: Column, *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
