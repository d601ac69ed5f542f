"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors on a few random directions, cuts every axis into cells of equal mass with edges shifted
by a part of a cell of its own, and orders the cells by Hilbert's curve.  Spark sorts the rows of all curves by range, so
every row has a position on every curve; a query meets the rows whose position is within the window of its own, and
what the curves find is merged and ranked by the exact distance.

How many curves and how wide a window is measured, not set: a bounded sample of the rows (``PROBES``) is searched by
brute force in one pass, and the positions of its true neighbours are told from a second sample (``SAMPLE``).  Of the
numbers of curves in ``CURVES`` the cheapest is taken, with the window that reaches ``AIM`` of those neighbours.  Windows
follow the data: narrow where vectors have few directions of their own, and, on noise in many dimensions, a part of all
rows, as any search that finds nine of ten there must.  Every row is on every curve.

Blocks of a curve have a bounded number of rows, and a query is sent to the blocks that its window touches, so no task
holds more however many vectors are alike.  Of equal vectors only the rows of the ``k`` + 1 smallest ids are candidates
(``can_be_near``), which loses nothing.

Defined cases
- a null id, or a vector that is null, empty, zero or has a null or non-finite component, takes no part; vectors of
  another length than the query's are no candidates of it;
- equal distances: the smaller vec_id first; rows with the query's own id are never found; repeated rows are separate
  candidates (``k`` an id at most); a repeated query counts once, and results of equal ids are merged;
- distances beyond the range of a double are infinite; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_side
from .vectors import can_be_near, finite, of_length, rows_of

K = 10
#: Numbers of curves to choose from, axes of a curve, and bits of an axis.
CURVES = (4, 8, 16, 32)
AXES, BITS = 8, 7
#: Rows whose neighbours are found by brute force, rows that positions are told from, and the share of neighbours to reach.
PROBES, SAMPLE = 256, 20_000
AIM = 0.97
#: What it costs to bring a row to one curve, in distances.
SHIP = 64.0
#: Rows in a block of a curve.
LEAST, MOST = 2048, 65_536
SEED = 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell, a row of coordinates below 2 ** ``bits``, on Hilbert's curve, as a whole number.

    The rotations are undone from the highest bit to the lowest, then the Gray code is read off.
    """
    x = cells.astype(np.uint64).T.copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        mask, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for i in range(axes):
            up = (x[i] & mask) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(bit)) & np.uint64(1), np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key


class Curve:
    """One ordering of vectors of one length: directions, and the shifted edges of the cells on each axis."""

    def __init__(self, number: int, sample: np.ndarray):
        n = sample.shape[1]
        rng = np.random.default_rng((SEED, n, number))
        self.directions = rng.normal(size=(n, min(AXES, n)))
        shifts = rng.uniform(-0.5, 0.5, self.directions.shape[1])
        cells = 1 << BITS
        places = np.clip((np.arange(1, cells)[:, None] + shifts) / cells, 0.0, 1.0)
        on = self.project(sample)
        self.edges = [np.quantile(on[:, i], places[:, i]) for i in range(on.shape[1])]

    def project(self, points: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num(points @ self.directions)

    def keys(self, points: np.ndarray) -> np.ndarray:
        on = self.project(points)
        cells = np.stack([np.searchsorted(edge, on[:, i], side="right") for i, edge in enumerate(self.edges)], axis=1)
        return hilbert(cells, BITS).astype(np.int64)  # AXES * BITS bits at most


def distances(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles, row by row, so that equal rows have equal ones."""
    with np.errstate(over="ignore"):
        d = np.sqrt(((points - query) ** 2).sum(axis=1))
        if not np.isfinite(d).all():  # squares beyond a double
            scale = max(float(np.abs(points).max()), float(np.abs(query).max()))
            d = np.sqrt(((points / scale - query / scale) ** 2).sum(axis=1)) * scale
        return d


def closest(query: np.ndarray, points: np.ndarray, rough: np.ndarray, ids: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` closest of the rows ``able`` and their distances; ``rough``: squared distances but for rounding."""
    if len(able) > k:
        some = rough[able]
        kth = np.partition(some, k - 1)[k - 1]
        if np.isfinite(kth):
            able = able[some <= kth + 1e-9 * (abs(kth) + float(query @ query))]
    d = distances(query, points[able])
    order = np.lexsort((ids[able], d))[:k]
    return able[order], d[order]


def roughly(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances by one product of matrices; rounding is in proportion to the vectors' lengths."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (queries**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * (queries @ points.T)
        return np.where(np.isnan(d), np.inf, d)


FOUND = "ask long, row long, vec_id long, score double"


def _found(out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    """Columns of ``FOUND`` from the number of what is asked with rows, ids and distances."""
    together = lambda i, kind: np.concatenate([x[i] for x in out]).astype(kind) if out else np.zeros(0, kind)
    ask = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64) if out else np.zeros(0, np.int64)
    return {"ask": pa.array(ask), "row": pa.array(together(1, np.int64)), "vec_id": pa.array(together(2, np.int64)), "score": pa.array(together(3, np.float64))}


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` closest rows of each ask; a row that several curves found counts once."""
    once = found.groupBy("ask", "row", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("ask").orderBy("score", "vec_id", "row")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _brute(asked, k: int):
    """Each batch's closest rows of everything asked: the true neighbours, after a merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids, row = rows_of(batch.column("x")), batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
            out = []
            for n, (asks, queries) in asked.value.items():
                at, points = of_length(lists, n)
                if len(at):
                    for ask, query, rough in zip(asks.tolist(), queries, roughly(queries, points), strict=True):
                        near, d = closest(query, points, rough, ids[at], np.arange(len(at)), k)
                        out.append((ask, row[at][near], ids[at][near], d))
            yield pa.RecordBatch.from_pydict(_found(out))

    return run


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers and vectors of a table of row and x."""
    lists, row = rows_of(table.column("x")), table.column("row").to_numpy()
    return {n: (row[at], x) for n in np.unique(lists[0]).tolist() for at, x in [of_length(lists, n)]}


def gaps(curve: Curve, sample: np.ndarray, probes: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """How far each probe's neighbour is from it on the curve at most, as a share of all rows, told from the sample.

    Rows of one cell stand in any order, so the whole cells of both count.
    """
    line = np.sort(curve.keys(sample))
    (low, high), (near_low, near_high) = ([np.searchsorted(line, curve.keys(points), side=side) for side in ("left", "right")] for points in (probes, neighbours))
    return np.maximum(near_high - low, high - near_low) / max(1, len(line))


def choose(all_gaps: np.ndarray, rows: int, sampled: int, every: int, aim: float) -> tuple[int, int]:
    """Number of curves and window, in rows: the cheapest of ``CURVES`` that reaches ``aim`` of the neighbours.

    A row is brought to each curve, and every ``every``-th meets both sides of its window there; a window is no narrower
    than three rows of the sample are apart, which is as fine as the sample can tell.
    """
    plans = []
    for n in CURVES:
        share = float(np.quantile(all_gaps[:n].min(axis=0), aim)) if all_gaps.size else 0.0
        window = int(np.ceil((share + 3 / max(1, sampled)) * rows))
        plans.append((n * (SHIP + 2 * window / every), n, window))
    return min(plans)[1:]


def fit(rows: DataFrame, k: int, every: int, aim: float) -> tuple[dict[int, list[Curve]], int, int]:
    """Curves by length of vectors, how many are used, and the window; ``rows`` has row, vec_id and x."""
    context = rows.sparkSession.sparkContext
    total = rows.count()
    chance = lambda most, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(1, total)) * (1 << 30)))
    sample = _by_length(rows.where(chance(0.9 * SAMPLE, 1)).select("row", "x").limit(SAMPLE).toArrow())
    curves = {n: [Curve(c, points) for c in range(max(CURVES))] for n, (_, points) in sample.items()}
    probes = _by_length(rows.where(chance(0.8 * PROBES, 2)).select("row", "x").limit(PROBES).toArrow())
    near = _best(rows.mapInArrow(_brute(context.broadcast(probes), k + 1), FOUND), k + 1).select("ask", "row")  # some PROBES * k rows
    near = rows.join(F.broadcast(near.where("ask <> row")), "row").select(F.col("ask").alias("row"), "x").toArrow()
    all_gaps = []
    for n, (asks, neighbours) in _by_length(near).items():
        if n in curves:
            of = dict(zip(probes[n][0].tolist(), probes[n][1], strict=True))
            start = np.array([of[i] for i in asks.tolist()])
            all_gaps.append(np.array([gaps(curve, sample[n][1], start, neighbours) for curve in curves[n]]))
    sampled = sum(len(asks) for asks, _ in sample.values())
    used, window = choose(np.concatenate(all_gaps, axis=1) if all_gaps else np.zeros((0, 0)), total, sampled, every, aim)
    return {n: c[:used] for n, c in curves.items()}, used, window


ON_CURVES = "row long, vec_id long, x array<double>, asked boolean, line long, key long"


def _placed(curves, used: int):
    """Each row once for every curve: ``line`` tells curve and length, ``key`` the place on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                lists = rows_of(batch.column("x"))
                for c in range(used):
                    key = np.zeros(batch.num_rows, np.int64)  # lengths that the sample has not met are rare: in any order
                    for n, orders in curves.value.items():
                        at, points = of_length(lists, n)
                        if len(at):
                            key[at] = orders[c].keys(points)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists[0].astype(np.int64) * max(CURVES) + c), pa.array(key)], names=[*batch.schema.names, "line", "key"])

    return run


def _in_block(window: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            points, queries = (rows_of(t.column("x"))[2].reshape(t.num_rows, -1) for t in (left, right))
            ids, row, place = (left.column(c).to_numpy() for c in ("vec_id", "row", "place"))
            asks, at = (right.column(c).to_numpy() for c in ("row", "place"))
            for start in range(0, len(asks), 64):
                some = queries[start : start + 64]
                for ask, p, query, rough in zip(asks[start : start + 64].tolist(), at[start : start + 64].tolist(), some, roughly(some, points), strict=True):
                    near, d = closest(query, points, rough, ids, np.flatnonzero(np.abs(place - p) <= window), k)
                    out.append((ask, row[near], ids[near], d))
        return pa.table(_found(out))

    return run


def _taking_part(vectors: DataFrame) -> DataFrame:
    able = vectors.where(F.col("vec_id").isNotNull() & finite("embedding")).where(F.exists("embedding", lambda v: v != 0))
    return able.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))


def nearest(vectors: DataFrame, *, every: int = 100, k: int = K, aim: float = AIM) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every vector whose id is divisible by ``every``."""
    context = vectors.sparkSession.sparkContext
    clean = materialize(_taking_part(vectors), "vectors")
    rows = materialize(can_be_near(clean, k).select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "rows")
    curves, used, window = fit(rows, k, every, aim)
    block = min(MOST, max(LEAST, window))

    # queries with equal vectors ask once, by the first row that has the vector; each leaves out its own id afterwards
    queries = clean.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x").distinct()
    first = rows.join(queries.select("x").distinct(), "x", "left_semi").groupBy("x").agg(F.min("row").alias("ask"))
    queries = materialize(queries.join(first, "x").select("query_id", "ask"), "queries")
    asks = queries.select(F.col("ask").alias("row"), F.lit(True).alias("asked")).distinct()
    rows = rows.join(small_side(asks), "row", "left").select("row", "vec_id", "x", F.coalesce("asked", F.lit(False)).alias("asked"))
    own = k if clean.groupBy("vec_id").count().where("count > 1").limit(1).count() else 1

    placed = rows.mapInArrow(_placed(context.broadcast(curves), used), ON_CURVES)  # SAMPLE bounds what is sent
    order = ["line", "key", F.xxhash64("vec_id"), "row"]
    tasks = max(partitions(vectors), 2 * used)
    placed = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "placed")

    # positions on each curve: rows of the tasks before, and the place within the task
    task = F.shiftright("at", 33)
    starts = placed.groupBy("line", task.alias("task")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("line").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(starts.select("line", "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "starts")
    placed = placed.withColumn("task", task).join(small_side(starts), ["line", "task"]).withColumn("place", F.col("at") + F.col("shift"))
    points = placed.select("line", F.floor(F.col("place") / block).alias("block"), "place", "row", "vec_id", "x")
    low, high = (F.floor((F.col("place") + F.lit(s * window)) / block) for s in (-1, 1))
    asked = materialize(placed.where("asked").select("line", F.explode(F.sequence(low, high)).alias("block"), "place", "row", "x"), "asked")
    found = points.groupBy("line", "block").cogroup(asked.groupBy("line", "block")).applyInArrow(_in_block(window, k + own), FOUND)
    found = queries.join(_best(found, k + own), "ask").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(vectors: DataFrame, found: DataFrame, *, every: int = 100, k: int = K) -> float:
    """The share of the true ``k`` nearest of up to ``PROBES`` queries that ``found`` holds, by brute force."""
    clean = materialize(_taking_part(vectors).withColumn("row", F.monotonically_increasing_id()), "all")
    probes = clean.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id")).limit(PROBES).select("row", "vec_id", "x").toArrow()
    asks = pa.table({"row": probes.column("vec_id"), "x": probes.column("x")})
    near = _best(clean.mapInArrow(_brute(clean.sparkSession.sparkContext.broadcast(_by_length(asks)), 2 * k), FOUND), 2 * k).where("ask <> vec_id")
    place = F.row_number().over(Window.partitionBy("ask").orderBy("score", "vec_id", "row"))
    near = near.withColumn("place", place).where(F.col("place") <= k).select(F.col("ask").alias("query_id"), "vec_id")
    met = found.select("query_id", "vec_id", F.lit(1).alias("met")).distinct()
    row = near.join(met, ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("met", F.lit(0)))).first()
    return 1.0 if row[0] is None else float(row[0])
