"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: A word is a run of bytes outside the ASCII white space \x20 \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The table survives lost executors and cuts the lineage, so a later stage that fails is redone
    from here.  The folder is removed when the driver exits.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle gets in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id written as text: the source of the fixed folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def plain_docs(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names do no harm."""
    return docs.select(*[F.col(c) for c in columns])


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the ``needed`` ones under names that no operator uses, and what gives them back.

    So an operator can add working columns, whatever the names of those that go along.
    """
    names = {c: c if c in needed else f"_kept{i}" for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    return docs.select(*[quoted(c).alias(n) for c, n in names.items()]), lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


#: Bytes of a side that is broadcast, at most.
MOST_BROADCAST = 16 << 20


def small_side(df: DataFrame, most_bytes: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``most_bytes``, else as it is, for a shuffled join.

    A row is taken to have 64 bytes of overhead in the join's table, and its columns at their widths; ``df`` has narrow
    columns only (numbers, or names of some length).  The rows are the same either way.
    """
    width = 64 + sum(8 if f.dataType.simpleString() not in ("string", "binary") else 256 for f in df.schema)
    most_rows = most_bytes // width
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
