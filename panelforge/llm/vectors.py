"""What the vector searches share: rows that take part, lists of doubles as arrays, and packed blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Integers up to this size are exact in double arithmetic, and the ends of a long.
EXACT = 2.0**53
LIMIT = 2**63 - 1


def finite(column: str) -> Column:
    """Whether the vector is there and every component is a finite number."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def rows_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, starts and all values of a column of lists of numbers, without Python objects."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    return np.diff(offsets), offsets[:-1], lists.values.to_numpy()


def of_length(rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a length, and their values, a row each."""
    lengths, starts, values = rows
    at = np.flatnonzero(lengths == n)
    return at, values[starts[at][:, None] + np.arange(n)]


def can_be_near(rows: DataFrame, k: int, *same: str) -> DataFrame:
    """Rows that can be among the ``k`` best of a query: of those equal in x and ``same`` the ``k`` + 1 smallest ids.

    Equal vectors have equal scores and ties go to smaller ids, so no others can be among them; an id has ``k`` rows
    at most.  ``rows`` has vec_id and x, and a vector that many rows share is no hot group afterwards.
    """
    hashed = rows.withColumn("_h", F.xxhash64("x"))
    n, ids = rows.agg(F.count(F.lit(1)), F.count_distinct("vec_id")).first()
    if n > ids:
        each = Window.partitionBy("_h", "x", *same, "vec_id").orderBy("vec_id")
        hashed = hashed.withColumn("_r", F.row_number().over(each)).where(F.col("_r") <= k).drop("_r")
    alike = Window.partitionBy("_h", "x", *same).orderBy("vec_id")
    return hashed.withColumn("_r", F.dense_rank().over(alike)).where(F.col("_r") <= k + 1).drop("_r", "_h")


def pack(table: pa.Table) -> bytes:
    """A table as one value: whole numbers held as doubles take a byte or two each."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()
