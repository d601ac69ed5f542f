"""Alerts with a cooldown, as a stream and as its batch twin; windowed counts; idempotent ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

COOLDOWN_S = 6 * 3600
FIRED = "event_type string, event_id long, ts timestamp_ntz, value double"


def _fold(rows: pd.DataFrame, last: int | None) -> tuple[list[tuple], int | None]:
    """Events that fire, and the time of the last one: each at least the cooldown after the one before."""
    out = []
    for t, e, k, v in sorted(zip(rows["ts"], rows["event_id"], rows["event_type"], rows["value"], strict=True)):
        s = round(t.value // 1000 / 1e6)  # whole seconds, halves to even, as in ``_seconds``
        if last is None or s - last >= COOLDOWN_S:
            out.append((k, e, t, v))
            last = s
    return out, last


def _seconds(ts: str) -> Column:
    """Whole seconds since 1970, halves to even, as SQL casts them."""
    return F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("long")


def _frame(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["event_type", "event_id", "ts", "value"])


def fired(events: DataFrame, threshold: float) -> DataFrame:
    """The batch twin: events over the threshold, less those within the cooldown of a fired one, by type.

    Time is cut into buckets as long as the cooldown, so that at most one event a bucket fires, and the next one to fire
    after an event is the first at least a cooldown later: one of the next bucket, or the first of the next bucket that
    has any.  That is found within the buckets; only firsts of buckets, one row each, are ordered by type.  What fires is
    then reached from a type's first event by doubling: with 2, 4, 8, ... steps known, n in a row take log n joins.
    """
    spark = events.sparkSession
    over = events.where(F.col("value") > threshold).select("event_type", "event_id", "ts", "value")
    over = over.withColumn("t", _seconds("ts")).withColumn("b", F.floor(F.col("t") / COOLDOWN_S))
    key = F.struct("t", "ts", "event_id")  # ids may be repeated: an event is its time and id
    over = over.groupBy("event_type", "ts", "event_id", "t", "b").agg(F.min("value").alias("value")).withColumn("key", key)
    firsts = over.groupBy("event_type", "b").agg(F.min("key").alias("first"))
    by_type = Window.partitionBy("event_type").orderBy("b")  # one row a bucket
    firsts = _kept(spark, firsts.select("event_type", "b", F.lag("first").over(by_type).isNull().alias("starts"), "first", F.lead("first").over(by_type).alias("after"), F.lead("b").over(by_type).alias("after_b"), F.lead("first", 2).over(by_type).alias("second")), "firsts")

    # an event's time a cooldown later falls into the next bucket: the first event there from then on
    none = F.lit(None).cast(over.schema["key"].dataType)
    targets = over.select("event_type", "b", "t", F.lit(1).alias("side"), F.col("key").alias("hit"), none.alias("key"))
    asks = over.select("event_type", (F.col("b") + 1).alias("b"), (F.col("t") + COOLDOWN_S).alias("t"), F.lit(0).alias("side"), none.alias("hit"), "key")
    ahead = Window.partitionBy("event_type", "b").orderBy("t", "side", "hit.ts", "hit.event_id").rowsBetween(0, Window.unboundedFollowing)
    hits = targets.unionByName(asks).withColumn("hit", F.first("hit", ignorenulls=True).over(ahead)).where("side = 0")
    own = firsts.select("event_type", (F.col("b") + 1).alias("b"), "after", "after_b", "second")
    # a bucket whose rest holds none: the first of the bucket after it
    beyond = F.when(F.col("after_b") == F.col("b"), F.col("second")).otherwise(F.col("after"))
    steps = hits.join(own, ["event_type", "b"]).select("event_type", "key", F.coalesce("hit", beyond).alias("to"))
    steps = _kept(spark, steps.where("to is not null"), "steps")
    reached = _kept(spark, firsts.where("starts").select("event_type", F.col("first").alias("key")), "reached")
    while True:
        more = reached.join(steps, ["event_type", "key"]).select("event_type", F.col("to").alias("key"))
        if more.isEmpty():
            return over.join(reached, ["event_type", "key"], "left_semi").select("event_type", "event_id", "ts", "value")
        reached = _kept(spark, reached.unionByName(more).distinct(), "reached")
        far = steps.select("event_type", F.col("key").alias("to"), F.col("to").alias("far"))
        steps = _kept(spark, steps.join(far, ["event_type", "to"]).select("event_type", "key", F.col("far").alias("to")), "steps")


def _kept(spark, df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that a round starts from a table."""
    path = scratch_path(spark, f"alerts-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stateful(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    found, last = _fold(pd.concat(list(frames)), last)
    if last is not None:
        state.update((last,))
    yield _frame(found)


def fired_stream(events: DataFrame, threshold: float) -> DataFrame:
    """The stream: the state of a rule is the time it last fired; events come in order of time."""
    over = events.where(F.col("value") > threshold).select("event_type", "event_id", "ts", "value")
    return over.groupBy("event_type").applyInPandasWithState(_stateful, FIRED, "last long", "append", "NoTimeout")


def hourly(events: DataFrame, late: str = "2 hours", stamp: str = "ts") -> DataFrame:
    """Counts by type and hour, for a stream with a watermark or for a batch."""
    timed = events.withColumn("at", F.col(stamp).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    out = timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value")).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def upsert_batch(path: str, *keys: str):
    """A foreachBatch sink that keeps the newest row of each key in a Parquet table of versions."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col("version")).alias("r")).select("r.*")
        newest.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
