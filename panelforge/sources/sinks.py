"""Sinks: keyed upsert, insert-ignore, reports, purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(existing: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``existing`` with the rows of ``changes`` in place of those with the same key, and the new ones."""
    return existing.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def inserted(existing: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``existing`` and the rows of ``changes`` whose key it does not have."""
    return existing.unionByName(changes.join(existing.select(*keys), list(keys), "left_anti"))


def write_upsert(existing: DataFrame, changes: DataFrame, path: str, partition: str, *keys: str) -> None:
    """Rewrite only the partitions of a Parquet table that changes touch."""
    touched = changes.select(partition).distinct()
    part = existing.join(touched, partition, "left_semi")
    merged = upserted(part, changes, *keys)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def first_of(frames: list[DataFrame], *keys: str) -> DataFrame:
    """The union of frames with one row a key, from the earliest frame that has it (rows of one frame by all columns)."""
    numbered = [f.withColumn("_at", F.lit(i)) for i, f in enumerate(frames)]
    both = numbered[0]
    for f in numbered[1:]:
        both = both.unionByName(f)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", *[c for c in frames[0].columns if c not in keys]))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_at")


def report(df: DataFrame, path: str, rows: int, *order: str) -> None:
    """A capped, ordered CSV report; the cap is the report's."""
    df.orderBy(*order).limit(rows).write.mode("overwrite").csv(path, header=True)


def purge_counts(tables: dict[str, tuple[DataFrame, str]], floor: str) -> DataFrame:
    """What a purge of rows before ``floor`` would delete and keep, by table."""
    out = None
    for name, (df, column) in sorted(tables.items()):
        old = F.col(column) < F.lit(floor).cast("date")
        row = df.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept")).select(F.lit(name).alias("table_name"), "deleted", "kept")
        out = row if out is None else out.unionByName(row)
    return out
