"""Window frames and arithmetic that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_asset(*order: str) -> WindowSpec:
    return Window.partitionBy("asset_id").orderBy(*(order or ("d",)))


def trailing(n: int, end: int = 0) -> WindowSpec:
    """The last ``n`` rows of an asset, up to ``end`` rows before the current one."""
    return by_asset().rowsBetween(-(n - 1) - end, -end)


def four(x: Column) -> Column:
    """Rounded half up to four places, the same in every engine."""
    return F.floor(x * 10000 + 0.5) / 10000


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mean(x: str, n: int, end: int = 0) -> Column:
    """Mean of integers over the last ``n`` rows; null with fewer."""
    w = trailing(n, end)
    return F.when(F.count(x).over(w) == n, F.sum(x).over(w) / F.lit(float(n)))


def spread(x: str, n: int) -> Column:
    """Population standard deviation of integers over the last ``n`` rows, from exact sums; null with fewer."""
    w = trailing(n)
    s, ss = F.sum(x).over(w), F.sum(F.col(x) * F.col(x)).over(w)
    return F.when(F.count(x).over(w) == n, F.sqrt((n * ss - s * s).cast("double")) / F.lit(float(n)))


def running(df: DataFrame, *names: str, squares: tuple[str, ...] = ()) -> DataFrame:
    """Adds an asset's running counts and sums of integers, and of the squares of some: what the sums of trailing rows are differences of.

    A frame of n rows is summed anew at each row; a running sum is not.  Sums are exact up to 2 ** 63.
    """
    w = by_asset().rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_n_{x}": F.count(x).over(w) for x in names} | {f"_s_{x}": F.sum(x).over(w) for x in names}
    return df.withColumns(sums | {f"_q_{x}": F.sum(F.col(x) * F.col(x)).over(w) for x in squares})


def trailed(column: str, n: int, end: int = 0) -> Column:
    """The part of a ``running`` column that the last ``n`` rows have, up to ``end`` rows before the current one."""
    at = lambda k: F.lag(column, k).over(by_asset()) if k else F.col(column)
    return F.coalesce(at(end), F.lit(0)) - F.coalesce(at(n + end), F.lit(0))


def run_mean(x: str, n: int, end: int = 0) -> Column:
    """``mean`` from the columns of ``running``."""
    return F.when(trailed(f"_n_{x}", n, end) == n, trailed(f"_s_{x}", n, end) / F.lit(float(n)))


def run_spread(x: str, n: int) -> Column:
    """``spread`` from the columns of ``running``."""
    s, ss = trailed(f"_s_{x}", n), trailed(f"_q_{x}", n)
    return F.when(trailed(f"_n_{x}", n) == n, F.sqrt((n * ss - s * s).cast("double")) / F.lit(float(n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))
