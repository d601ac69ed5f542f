"""Exact nearest neighbours by inner product with KD-trees.

Vectors are dealt to shards by median splits of a bounded sample, so that a shard is a box of neighbours; a shard that
came out too large is dealt on by a hash.  A task gets one shard with one block of queries, builds the shard's KD-tree
(median splits, tight bounding boxes) and searches it best first: the boxes in order of their bound on the inner
product, until the bound falls below the k-th score so far.

A first round searches each query's home shard only.  Its k-th score goes with the query to those of the other shards
whose own box has a bound that reaches it: boxes, two vectors a shard, are sent to all tasks in parts of at most
``PART`` bytes, one part after the other.  Shards and blocks of queries have about the same size, so that each is
shipped as often as the other has parts, and a task's memory is bounded by both.

Of equal vectors only those that can be among a query's nearest are candidates: the rows of the ``k`` + 1 smallest ids,
``k`` rows an id at most.  That loses no result, and a vector that many rows share is one small shard.

Defined cases
- a vector that is null, or has a null or non-finite component, takes no part; so do vectors of another length
  than a query's for that query, and null ids;
- an empty vector has score 0 with every other empty vector;
- equal scores: the smaller vec_id first; a box whose bound equals the k-th score is still opened;
- scores beyond the range of a long are ranked as they are and returned as its ends;
- repeated rows are separate candidates; a query's own id is never one; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import EXACT, LIMIT, can_be_near, finite, of_length, rows_of

K = 5
SCALE = 256
#: Vectors in a shard, about, and queries in a block; vectors in a leaf of a tree.
SHARD = 16_384
QUERIES = 16_384
LEAF = 128
#: Vectors that the shards' splits are made from, at most, and bytes of boxes that are sent at once.
SAMPLE = 20_000
PART = 32 << 20


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Tree:
    """KD-tree over the rows of ``points`` (integers held as doubles) with their ids."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.kids: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        self._split(np.arange(len(ids)))
        self.low = np.array([a for a, _ in self.boxes])
        self.high = np.array([b for _, b in self.boxes])

    def _split(self, rows: np.ndarray) -> int:
        at = len(self.boxes)
        some = self.points[rows]
        low, high = some.min(axis=0), some.max(axis=0)
        self.boxes.append((low, high))
        self.kids.append(None)
        self.rows.append(None)
        wide = high - low
        if len(rows) <= LEAF or not wide.size or wide.max() <= 0:
            self.rows[at] = rows
            return at
        axis = int(wide.argmax())
        order = np.argsort(some[:, axis], kind="stable")
        half = len(rows) // 2
        left = self._split(rows[order[:half]])
        self.kids[at] = (left, self._split(rows[order[half:]]))
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query, a row, can have within each box."""
        return bounds(queries, self.low, self.high)

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, kth: float) -> list[tuple[int, int]]:
        """Up to ``k`` (score, id), best first; only scores of at least ``kth`` matter."""
        found: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            if -bound < kth:
                break
            if self.kids[at] is not None:
                for kid in self.kids[at]:
                    if bounds[kid] >= kth:
                        heapq.heappush(heap, (-bounds[kid], kid))
                continue
            rows = self.rows[at]
            scores = self.points[rows] @ query
            near = np.flatnonzero((scores >= kth) & (self.ids[rows] != own))
            if len(near):
                found += zip((-scores[near]).tolist(), self.ids[rows[near]].tolist(), strict=True)
                found = heapq.nsmallest(k, found)
                if len(found) == k:
                    kth = max(kth, -found[-1][0])
        return [(int(-s), i) for s, i in found]


class WideTree(Tree):
    """The same where products pass 2 ** 53: Python integers."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        super().__init__(ids, points.astype(object))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries[:, None, :] * self.low, queries[:, None, :] * self.high).sum(axis=2)

    def _split(self, rows: np.ndarray) -> int:
        self.boxes.append((self.points[rows].min(axis=0), self.points[rows].max(axis=0)))
        self.kids.append(None)
        self.rows.append(rows)
        return 0


FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q_all, i_all, s_all = [], [], []
        ids = left.column("vec_id").to_numpy()
        own_ids, kths = right.column("query_id").to_numpy(), right.column("kth").to_numpy(zero_copy_only=False)
        points_of, queries_of = rows_of(left.column("x")), rows_of(right.column("asked"))
        for n in np.intersect1d(points_of[0], queries_of[0]).tolist():
            rows, points = of_length(points_of, n)
            asked, queries = of_length(queries_of, n)
            wide = float(np.abs(points).max(initial=0)) * float(np.abs(queries).sum(axis=1).max(initial=0)) >= EXACT
            if wide:
                points, queries = (np.array([[int(v) for v in x] for x in some], object).reshape(some.shape) for some in (points, queries))
            tree = (WideTree if wide else Tree)(ids[rows], points)
            for at in range(0, len(asked), 1024):
                some = queries[at : at + 1024]
                for row, query, limit in zip(asked[at : at + 1024].tolist(), some, tree.bounds(some), strict=True):
                    kth = kths[row]
                    hits = tree.search(query, limit, int(own_ids[row]), k, -np.inf if np.isnan(kth) else kth)
                    q_all += [int(own_ids[row])] * len(hits)
                    s_all += [max(-LIMIT, min(LIMIT, s)) for s, _ in hits]
                    i_all += [i for _, i in hits]
        return pa.table({"query_id": pa.array(q_all, pa.int64()), "vec_id": pa.array(i_all, pa.int64()), "score": pa.array(s_all, pa.int64())})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Splits:
    """Median splits of a sample of vectors of one length: which shard a vector is in."""

    def __init__(self, points: np.ndarray, shards: int, first: int):
        self.axis, self.value, self.left, self.right, self.leaves = [], [], [], [], 0
        self.first = first
        self._split(points, shards)

    def _split(self, points: np.ndarray, shards: int) -> int:
        """A node's number; leaves count downwards from -1."""
        wide = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(0)
        if shards < 2 or not wide.size or wide.max() <= 0:
            self.leaves += 1
            return -self.leaves
        axis = int(wide.argmax())
        value = float(np.median(points[:, axis]))
        low = points[:, axis] <= value
        if low.all():
            value = float(points[~(points[:, axis] >= value), axis].max())
            low = points[:, axis] <= value
        at = len(self.axis)
        self.axis.append(axis)
        self.value.append(value)
        self.left.append(0)
        self.right.append(0)
        self.left[at] = self._split(points[low], shards // 2)
        self.right[at] = self._split(points[~low], shards - shards // 2)
        return at

    def shards(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64) if self.axis else np.full(len(points), -1)
        axis, value, left, right = map(np.array, (self.axis, self.value, self.left, self.right))
        while (open_ := np.flatnonzero(node >= 0)).size:
            at = node[open_]
            node[open_] = np.where(points[open_, axis[at]] <= value[at], left[at], right[at])
        return self.first - node - 1


def _dealer(splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch.column("x"))
            shard = -1 - rows[0].astype(np.int64)  # a length that the sample has not met is a shard of its own
            for n, some in splits.value.items():
                at, points = of_length(rows, n)
                shard[at] = some.shards(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    return run


def _box(table: pa.Table) -> pa.Table:
    """Tight boxes of one shard, one for each length of vectors."""
    rows = rows_of(table.column("x"))
    found = [(n, of_length(rows, n)[1]) for n in np.unique(rows[0]).tolist()]
    low, high = ([getattr(points, f)(axis=0).astype(np.float64).tobytes() for _, points in found] for f in ("min", "max"))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * len(found), pa.int64()), "n": pa.array([n for n, _ in found], pa.int64()), "low": pa.array(low, pa.binary()), "high": pa.array(high, pa.binary())})


ASKED = "query_id long, asked array<double>, home long, block int, kth double"


def _router(boxes):
    """A row for each query and shard other than its home whose box reaches the query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: (np.array(shards), *[np.frombuffer(b"".join(x), np.float64).reshape(len(shards), n) for x in ends]) for n, (shards, *ends) in boxes.value.items()}
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows, home = rows_of(batch.column("asked")), batch.column("home").to_numpy()
                kth = batch.column("kth").to_numpy(zero_copy_only=False)
                for n, (shards, low, high) in found.items():
                    at, queries = of_length(rows, n)
                    if not len(at):
                        continue
                    limit = bounds(queries, low, high)
                    limit += np.abs(limit) * 1e-12  # sums beyond 2 ** 53 are rounded
                    q, b = np.nonzero(~(limit < kth[at][:, None]) & (shards[None, :] != home[at][:, None]))
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at[q])).columns, pa.array(shards[b])], names=[*batch.schema.names, "shard"])

    return run


def nearest(vectors: DataFrame, *, every: int = 50, k: int = K, shard: int = SHARD, block: int = QUERIES, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest of every vector whose id is divisible by ``every``."""
    context = vectors.sparkSession.sparkContext
    clean = vectors.where(F.col("vec_id").isNotNull() & finite("embedding"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    clean = materialize(clean.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x")), "vectors")

    rows = clean.count()
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, 2 * rows)) * (1 << 30)))
    sample = rows_of(clean.where(share).select("x").limit(SAMPLE).toArrow().column("x"))  # for splits only; every row is dealt
    splits, first = {}, 0
    for n in np.unique(sample[0]).tolist():
        some = of_length(sample, n)[1]
        splits[n] = Splits(some, max(1, round(rows * len(some) / len(sample[0]) / shard)), first)
        first += splits[n].leaves
    deal = _dealer(context.broadcast(splits))  # SAMPLE bounds its size

    dealt = materialize(can_be_near(clean, k).select("vec_id", "x").mapInArrow(deal, "vec_id long, x array<double>, shard long"), "dealt")
    sizes = materialize(dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (2 * shard)).alias("parts")), "shards")
    at = F.pmod(F.xxhash64("vec_id"), F.col("parts")) * (1 << 40) + F.col("shard")
    points = materialize(dealt.join(sizes, "shard").select("vec_id", "x", at.alias("shard")), "points")
    boxes = materialize(points.groupBy("shard").applyInArrow(_box, "shard long, n long, low binary, high binary"), "boxes")

    asked = clean.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"]).mapInArrow(deal, "vec_id long, x array<double>, shard long")
    asked = asked.join(sizes, "shard", "left")
    home = F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))) * (1 << 40) + F.col("shard")
    blocks = max(1, -(-rows // (every * block)))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("asked"), home.alias("home"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    asked = materialize(asked, "queries")

    def search(some: DataFrame) -> DataFrame:
        """``some`` has query_id, asked, block, kth and the shard to search."""
        met = materialize(some.select("shard", "block").distinct(), "met")
        left = points.join(met, "shard").groupBy("shard", "block")
        return left.cogroup(some.groupBy("shard", "block")).applyInArrow(_search(k), FOUND)

    first_hits = materialize(search(asked.withColumns({"shard": F.col("home"), "kth": F.lit(None).cast("double")})), "home-hits")
    # repeated ids have several vectors; the lowest k-th score of an id serves them all
    kth = _best(first_hits, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    repeated = asked.groupBy("query_id").count().where("count > 1").select("query_id")
    kth = kth.join(repeated, "query_id", "left_anti")
    asked = materialize(asked.join(kth, "query_id", "left").select("query_id", "asked", "home", "block", "kth"), "queries")

    bytes_ = boxes.agg(F.coalesce(F.sum(F.length("low") * 2 + 64), F.lit(0))).first()[0]
    hits, parts = first_hits, max(1, -(-bytes_ // part))
    for i in range(parts):
        found: dict[int, tuple[list, list, list]] = {}
        for r in boxes.where(F.pmod(F.xxhash64("shard", "n"), F.lit(parts)) == i).collect():  # ``part`` bytes, about
            for to, value in zip(found.setdefault(r["n"], ([], [], [])), (r["shard"], bytes(r["low"]), bytes(r["high"])), strict=True):
                to.append(value)
        routed = materialize(asked.mapInArrow(_router(context.broadcast(found)), f"{ASKED}, shard long"), "routed")
        hits = hits.unionByName(materialize(search(routed), "hits"))
    return _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
