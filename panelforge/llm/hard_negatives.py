"""Hard negatives by slots: for each anchor and positive the best rows of other labels below the positive's score.

Two exact searches of the anchors against all rows, in blocks.  The first finds an anchor's positives among the rows of
its label.  For the second, the upper limits of its positives, in order, split the scores into disjoint slots; a task
keeps the ``k`` best of each slot, so do the combiners after it.  The window of a positive is a slot and all those below
it: the suffix of the anchor's kept rows, best first, from its upper limit on; its first ``k`` are the ``k`` best of the
whole window, wherever the windows overlap.

Rows are packed into chunks and anchors into blocks, one row each; a task gets one chunk with one block, at most
``MOST`` rows of either.  So all that is shipped is each chunk once for a block and each block once for a chunk; labels
are gathered into families of a chunk's size, and a label that many rows have is a family of many chunks.

Defined cases
- a null id or label, or a vector that is null or has a null or non-finite component, takes no part; vectors of
  another length than the anchor's are no candidates of it;
- a positive below 0 has an empty window, as 50 % of its score are more than 95 % of it;
- equal scores: the smaller vec_id first; rows with the anchor's id are never its positives;
- repeated rows are separate candidates (as many as can be returned); a repeated anchor counts once, and rows that share
  an id but not their label and vector are anchors each;
- scores beyond the range of a long count as its ends; an empty table, or one label, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_side
from .vectors import EXACT, LIMIT, can_be_near, finite, of_length, pack, rows_of, unpack

SCALE = 256
POSITIVES = 5
K = 3
#: Window of a negative's score, in percent of its positive's.
LOW, HIGH = 50, 95
#: Rows in a chunk, and anchors in a block: as many as give each partition of the session one, within these.
LEAST, MOST = 1024, 65_536
#: Anchors that are scored against a chunk at once.
AT_ONCE = 128


def scores(asked: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products, exact within a long: doubles where they hold all of them, else longs from Python's integers."""
    if float(np.abs(points).max(initial=0)) * float(np.abs(asked).sum(axis=1).max(initial=0)) < EXACT:
        return asked @ points.T
    whole = [np.array([[int(v) for v in x] for x in some], object).reshape(some.shape) for some in (asked, points)]
    return np.clip(whole[0] @ whole[1].T, -LIMIT, LIMIT).astype(np.int64)


def best(found: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``found`` the ``k`` best, ties to smaller ids."""
    if len(found) > k:
        some = score[found]
        found = found[some >= np.partition(some, len(some) - k)[len(some) - k]]
    return found[np.lexsort((ids[found], -score[found]))[:k]]


def limits(positives: list[int], low: int, high: int) -> tuple[list[int], int]:
    """Upper limits of the positives' windows, falling, and the least of their lower limits."""
    able = [p for p in positives if p >= 0]
    return sorted({high * p // 100 for p in able}, reverse=True), min((-(-low * p // 100) for p in able), default=0)


def _positives(k: int):
    def pick(score: np.ndarray, ids: np.ndarray, labels: np.ndarray, own: int, label: int, _) -> list[tuple[int, np.ndarray]]:
        return [(0, best(np.flatnonzero((labels == label) & (ids != own)), score, ids, k))]

    return pick


def _negatives(k: int, low: int, high: int):
    def pick(score: np.ndarray, ids: np.ndarray, labels: np.ndarray, own: int, label: int, positives: list[int]) -> list[tuple[int, np.ndarray]]:
        upper, least = limits(positives, low, high)
        if not upper:
            return []
        rows = np.flatnonzero((labels != label) & (score <= upper[0]) & (score >= least))
        slot = (score[rows][:, None] <= np.array(upper)).sum(axis=1) - 1 if len(rows) else rows
        return [(s, best(rows[slot == s], score, ids, k)) for s in np.unique(slot).tolist()]

    return pick


FOUND = "a long, slot int, vec_id long, score long"


def _search(pick):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            rows, anchors = (unpack(t.column("data")[0].as_py()) for t in (left, right))
            ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
            own, label, number = (anchors.column(c).to_numpy() for c in ("vec_id", "label", "a"))
            positives = anchors.column("positives").to_pylist()
            points_of, asked_of = rows_of(rows.column("x")), rows_of(anchors.column("x"))
            for n in np.intersect1d(points_of[0], asked_of[0]).tolist():
                at, points = of_length(points_of, n)
                by, asked = of_length(asked_of, n)
                for start in range(0, len(by), AT_ONCE):
                    for i, score in zip(by[start : start + AT_ONCE].tolist(), scores(asked[start : start + AT_ONCE], points), strict=True):
                        for slot, hits in pick(score, ids[at], labels[at], int(own[i]), int(label[i]), positives[i]):
                            for column, values in zip(out, ([int(number[i])] * len(hits), [slot] * len(hits), ids[at][hits].tolist(), [int(s) for s in score[hits]]), strict=True):
                                column += values
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("a", "slot", "vec_id", "score"), out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    return run


def _packed(key: str):
    def run(group: pa.Table) -> pa.Table:
        return pa.table({"family": group.column("family")[:1], key: group.column(key)[:1], "data": pa.array([pack(group.drop_columns(["family", key]))], pa.binary())})

    return run


def in_blocks(rows: DataFrame, anchors: DataFrame, size: int, pick, name: str) -> DataFrame:
    """What ``pick`` finds for each anchor among the rows of its family, a chunk of rows and a block of anchors at a time."""
    counts = rows.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / size).alias("chunks"))
    counts = materialize(counts.join(anchors.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks")), "family"), f"{name}-families")
    sides = []
    for side, key, own, other in ((rows, "chunk", "chunks", "blocks"), (anchors, "block", "blocks", "chunks")):
        dealt = side.join(small_side(counts.select("family", own)), "family")
        dealt = dealt.withColumn(key, F.pmod(F.xxhash64("vec_id", "x", F.lit(key)), F.col(own))).drop(own)
        one = materialize(dealt.groupBy("family", key).applyInArrow(_packed(key), f"family long, {key} long, data binary"), f"{name}-{key}s")
        with_ = "block" if key == "chunk" else "chunk"
        sides.append(one.join(small_side(counts.select("family", other)), "family").withColumn(with_, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop(other))
    left, right = (side.groupBy("family", "chunk", "block") for side in sides)
    return left.cogroup(right).applyInArrow(_search(pick), FOUND)


def mine(vectors: DataFrame, *, every: int = 50, positives: int = POSITIVES, k: int = K, low: int = LOW, high: int = HIGH, size: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows of ``vectors`` (vec_id, embedding, label) whose id is divisible by ``every``; scores are inner
    products of the components' 256ths.  ``size`` sets the rows of a chunk and of a block.
    """
    whole = dict(vectors.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    label = F.col("label").cast("long") if whole else F.xxhash64("label")
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    clean = materialize(clean.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), scaled.alias("x")), "vectors")
    rows = materialize(can_be_near(clean, max(positives, k), "label"), "candidates")
    n = rows.count()
    size = size or min(MOST, max(LEAST, -(-n // partitions(vectors))))
    families = max(1, n // size)
    family = F.pmod(F.xxhash64("label"), F.lit(families))
    anchors = clean.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "x"])
    anchors = materialize(anchors.withColumn("a", F.monotonically_increasing_id()), "anchors")

    none = F.array().cast("array<long>")
    same = in_blocks(rows.withColumn("family", family), anchors.withColumns({"family": family, "positives": none}), size, _positives(positives), "same")
    first = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "vec_id"))
    chosen = same.withColumn("rank", first).where(F.col("rank") <= positives)
    chosen = materialize(chosen.select("a", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    wanted = chosen.groupBy("a").agg(F.collect_list("positive_score").alias("positives"))  # a few an anchor
    one = F.lit(0).cast("long")
    asked = materialize(anchors.join(wanted, "a").withColumn("family", one), "asked")
    other = in_blocks(rows.withColumn("family", one), asked, size, _negatives(k, low, high), "other")
    inside = F.row_number().over(Window.partitionBy("a", "slot").orderBy(F.desc("score"), "vec_id"))
    kept = other.withColumn("rank", inside).where(F.col("rank") <= k)
    kept = kept.groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))).alias("kept"))  # ``k`` a slot

    score, of = (lambda r: -r["low"].cast("decimal(20,0)")), F.col("positive_score").cast("decimal(20,0)")
    window = F.slice(F.filter("kept", lambda r: (score(r) * 100 <= of * high) & (score(r) * 100 >= of * low)), 1, k)
    found = chosen.join(kept, "a").select("a", "positive_id", "positive_score", F.posexplode(window).alias("at", "n"))
    return found.join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a").select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("n.vec_id").alias("negative_id"),
        "positive_score",
        (-F.col("n.low")).alias("negative_score"),
    )
