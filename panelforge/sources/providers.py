"""Readers of provider tables: a mapping of columns for each provider, one schema for all, and fallbacks between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """How a provider's columns become ours: our name to an SQL expression over theirs, and which must not be null."""

    columns: dict[str, str]
    needed: tuple[str, ...] = field(default=())


def mapped(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """The provider's rows in our columns; rows without what is needed go."""
    out = raw.select(*[F.expr(x).alias(name) for name, x in mapping.columns.items()])
    return out.dropna(subset=list(mapping.needed)) if mapping.needed else out


def dispatch(raw: dict[str, DataFrame], mappings: dict[str, Mapping]) -> DataFrame:
    """All providers that have a mapping, one below the other, with their name; one that has none is an error."""
    if unknown := sorted(set(raw) - set(mappings)):
        raise ValueError(f"no mapping for {', '.join(unknown)}")
    out = None
    for name in sorted(raw):
        part = mapped(raw[name], mappings[name]).withColumn("provider", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def url_of(url: Column, *parts: Column) -> Column:
    """The URL, or one made from a digest of the parts where there is none."""
    made = F.concat(F.lit("news://"), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) != "", url).otherwise(made)


def last_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key: the last in order; an aggregate, so that no key's rows are sorted in one task."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def filled(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Every key of either; each field from the primary provider, where it has one, else from the fallback."""
    a, b = primary.alias("a"), fallback.alias("b")
    names = [c for c in primary.columns if c != key]
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in names])


def backward_windows(days: DataFrame, latest: str, floor: str, step: int) -> DataFrame:
    """step, start_d, end_d: windows of ``step`` days back from the day before the oldest row, or ``latest``, to the floor."""
    known = days.agg(F.date_sub(F.coalesce(F.min("d"), F.date_add(F.lit(latest).cast("date"), 1)), 1).alias("last"))
    low = F.lit(floor).cast("date")
    ends = known.where(F.col("last") >= low).select("last", F.posexplode(F.sequence(F.col("last"), low, F.expr(f"interval -{step} days"))).alias("step", "end_d"))
    return ends.select("step", F.greatest(F.date_sub("end_d", step - 1), low).alias("start_d"), "end_d")


def chunks(days: DataFrame, size: int) -> DataFrame:
    """chunk, start_d, end_d, n: runs of ``size`` trading days; one row a day is ordered."""
    no = days.select("d", F.floor((F.row_number().over(Window.orderBy("d")) - 1) / size).alias("chunk"))
    return no.groupBy("chunk").agg(F.min("d").alias("start_d"), F.max("d").alias("end_d"), F.count(F.lit(1)).alias("n"))


def open_chunks(all_chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that are not among the finished ones: where a run that was stopped goes on."""
    return all_chunks.join(done.select("chunk").distinct(), "chunk", "left_anti")
