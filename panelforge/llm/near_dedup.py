"""Near-duplicate groups of documents.

1. Every document's shingle set gets SetSketch registers (``setsketch``); equal sets become one class.
2. Classes that agree in a band of registers share a bucket.  Each bucket's most connected class is its pivot
   (the sum of the sizes of a class's buckets is a cheap measure of that): members are paired with their pivot,
   not with each other, so a group of n near copies gives some n pairs.
3. A joint likelihood estimate from both sketches drops pairs far below the threshold; the rest are confirmed
   on their whole sets.
4. Links give components.  Buckets whose members are still in different components are compared whole: a bucket's
   members are dealt to blocks by size class, as sets of which one has less than 0.8 of the other can't link, and a
   task gets two blocks of sketches.  It looks at pairs across components that share no earlier band and whose estimate
   is high enough, and returns the members that have such a pair; only their sets are then shipped, for each pair of
   blocks, and compared in full.  What is returned are links that join components, fewer than a task has members.  So
   pivots lose no link, and no pairs are emitted.  For a bucket of n texts that resemble each other without being linked,
   sketches (some 600 bytes) are shipped n * n / ``BLOCK`` times at most, three times that over neighbouring classes.

A pair at the threshold shares no bucket with probability (1 - 0.8 ** 6) ** 48 < 1e-6; sets are compared by
64-bit hashes of their shingles.

Defined cases
- null text or no word: empty set, linked with nothing, its own component;
- rows are told apart by a unique number: the id where every row has its own, else one that is written with them;
- repeated rows: each row is returned, with the component of its set; equal sets are linked;
- the same id with different texts: each row has the component of its own text, though both may report that id;
- ``component_id`` is the smallest id in the component that is not null, and null where all are;
- ``kept`` holds for one row of each component: that of the smallest id, null ids last; of equal ids, the first row;
- ties for pivots go to the smaller class; empty table: empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsketch as ss
from .common import materialize, set_aside, small_side

PERCENT = 80
#: Pairs whose estimate is lower are not compared in full: six standard errors below the threshold.
ESTIMATE_FLOOR = 0.8 - 6 * (0.8 * 0.2 / ss.REGISTERS) ** 0.5
#: Members in a block, and pairs of them that are estimated at once.
BLOCK = 512
PAIRS = 20_000
#: Buckets with up to so many members are compared whole, in bundles of about so many members.
SMALL = 128
BUNDLE = 512

SKETCH = "row long, doc_id long, n_shingles long, digest binary, sketch binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = ss.Shingler(k)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingler.shingles(t) for t in batch.column(2).to_pylist()]
                full = [s for s in sets if len(s)]
                sketches = iter(ss.registers(full)) if full else iter(())
                out = [(ss.digest(s), next(sketches).tobytes()) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d for d, _ in out], pa.binary()),
                        pa.array([s for _, s in out], pa.binary()),
                    ],
                    names=_names(SKETCH),
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            if batch.num_rows:
                keys = ss.band_keys(_matrix(batch.column(1)))
                band = np.tile(np.arange(ss.BANDS, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), ss.BANDS)), pa.array(band)], names=["key", "node", "band"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), ss.REGISTERS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            if batch.num_rows:
                n = [batch.column(i).to_numpy().astype(float) for i in (2, 3)]
                good = ss.similarity(_matrix(batch.column(4)), _matrix(batch.column(5)), *n) >= ESTIMATE_FLOOR
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["node", "pivot"]).filter(pa.array(good))


def _sets(k: int):
    """(wanted node, partner, text) to (node, partner, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = ss.Shingler(k)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets, last, found = [], None, None
                for text in batch.column(2).to_pylist():
                    if text is not last:
                        last, found = text, shingler.shingles(text).tobytes()
                    sets.append(found)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["node", "pivot", "elements"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, pivots = [], []
            for node, pivot, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if _linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent):
                    nodes.append(node)
                    pivots.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(pivots, pa.int64())], names=["node", "pivot"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


MEMBER = "key long, i long, j long, block long, bucket long, band int, node long, component long, n_shingles long, sketch binary"


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that a task compares, some at a time: within each small bucket, or between two blocks."""
    low, high = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    if low < 0:
        bucket = table.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        some: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for rows in np.split(order, starts[1:]):
            p, q = np.triu_indices(len(rows), 1)
            some.append((rows[p], rows[q]))
            n += len(p)
            if n >= PAIRS:
                yield tuple(map(np.concatenate, zip(*some, strict=True)))
                some, n = [], 0
        if some:
            yield tuple(map(np.concatenate, zip(*some, strict=True)))
        return
    block = table.column("block").to_numpy()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    rows = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), rows):
        a = left[at : at + rows]
        p, q = np.repeat(a, len(right)), np.tile(right, len(a))
        yield (p[p < q], q[p < q]) if low == high else (p, q)


def _open_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a task that may link components.

    They are in different components, close in size, share no band before this one, and their estimate is high enough.
    """
    band, component, n = (table.column(c).to_numpy() for c in ("band", "component", "n_shingles"))
    sketch = _matrix(table.column("sketch"))
    keys = ss.band_keys(sketch)
    p_all, q_all = [np.empty(0, int)], [np.empty(0, int)]
    for p, q in _pairs(table):
        near = (np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * percent) & (component[p] != component[q])
        p, q = p[near], q[near]
        fresh = (keys[p] == keys[q]).argmax(axis=1) == band[p]
        p, q = p[fresh], q[fresh]
        good = ss.similarity(sketch[p], sketch[q], n[p].astype(float), n[q].astype(float)) >= ESTIMATE_FLOOR
        p_all.append(p[good])
        q_all.append(q[good])
    return np.concatenate(p_all), np.concatenate(q_all)


def _candidates(percent: int):
    """The members of a task that have a pair to compare."""

    def run(table: pa.Table) -> pa.Table:
        p, q = _open_pairs(table, percent)
        return table.take(pa.array(np.unique(np.concatenate([p, q])))).select(MEMBER_NAMES)

    return run


def _across(percent: int):
    """Links that join components between the two blocks of a task, as a forest."""

    def run(table: pa.Table) -> pa.Table:
        p, q = _open_pairs(table, percent)
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            x, y = find(component[i]), find(component[j])
            if x != y and _linked(sets[i], sets[j], percent):
                root[x] = y
                out.append((node[i], node[j]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"node": pa.array(a, pa.int64()), "pivot": pa.array(b, pa.int64())})

    return run


MEMBER_NAMES = _names(MEMBER)


def _texts(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, pivot, elements): the sets of the wanted nodes, which are row numbers, for each partner."""
    texts = docs.join(small_side(wanted), F.col("row") == F.col("node"))
    return texts.select("node", "pivot", "text").mapInArrow(_sets(k), "node long, pivot long, elements binary")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (node, pivot) that hold on the whole sets."""
    size = classes.select("node", "n_shingles", "sketch")
    pairs = pairs.join(size, "node").withColumnsRenamed({"n_shingles": "n_a", "sketch": "a"})
    pairs = pairs.join(size.withColumnsRenamed({"node": "pivot", "n_shingles": "n_b", "sketch": "b"}), "pivot")
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    likely = materialize(pairs.select("node", "pivot", "n_a", "n_b", "a", "b").mapInArrow(_likely, "node long, pivot long"), "likely")
    left = _texts(likely, docs, k).withColumnRenamed("elements", "a")
    alone = likely.select(F.col("pivot").alias("node")).distinct().withColumn("pivot", F.lit(None).cast("long"))
    right = _texts(alone, docs, k)
    both = left.join(right.select(F.col("node").alias("pivot"), F.col("elements").alias("b")), "pivot").select("node", "pivot", "a", "b")
    return materialize(both.mapInArrow(_confirm(percent), "node long, pivot long").distinct(), "links")


def _links_across(open_: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that hold between members (key, node, component, band) of the same buckets in different components."""
    members = materialize(open_.join(classes.select("node", "n_shingles", "sketch"), "node"), "open-sketches")
    # written, so that a bucket's joins are of two exchanges, which can be split
    totals = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "totals")
    size_class = F.floor(F.log("n_shingles") / F.lit(math.log(100 / percent))).cast("int")
    members = materialize(members.join(totals, "key").withColumn("class", size_class), "open-members")
    bundles = max(1, (totals.where(F.col("members") <= SMALL).agg(F.sum("members")).first()[0] or 0) // BUNDLE)
    rest = ("band", "node", "component", "n_shingles", "sketch")
    none = F.lit(-1).cast("long")
    small = members.where(F.col("members") <= SMALL).select(F.pmod(F.xxhash64("key"), F.lit(bundles)).alias("key"), none.alias("i"), none.alias("j"), none.alias("block"), F.col("key").alias("bucket"), *rest)

    large = members.where(F.col("members") > SMALL)
    sizes = materialize(large.groupBy("key", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    spread = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    at = large.join(sizes, ["key", "class"])
    for step in (-1, 1):
        beside = sizes.select("key", (F.col("class") - step).alias("class"), F.col("blocks").alias("below" if step < 0 else "above"))
        at = at.join(beside, ["key", "class"], "left")
    # a block's number has its class in front; a task has two blocks of one class or of neighbours
    number = lambda step, t: (F.col("class") + step).cast("long") * (1 << 32) + t
    own = number(0, spread)
    parts = []
    for step, blocks in ((0, F.col("blocks")), (-1, F.coalesce("below", F.lit(0))), (1, F.coalesce("above", F.lit(0)))):
        parts.append(F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), lambda t, s=step: F.struct(F.least(own, number(s, t)).alias("i"), F.greatest(own, number(s, t)).alias("j")))).otherwise(F.array()))
    dealt = at.withColumn("block", own).withColumn("task", F.explode(F.concat(*parts)))
    dealt = small.unionByName(dealt.select("key", "task.i", "task.j", "block", F.col("key").alias("bucket"), *rest))
    near = materialize(dealt.groupBy("key", "i", "j").applyInArrow(_candidates(percent), MEMBER), "candidates")
    sets = _texts(near.select("node").distinct().withColumn("pivot", F.lit(None).cast("long")), docs, k).select("node", "elements")
    links = near.join(sets, "node").groupBy("key", "i", "j").applyInArrow(_across(percent), "node long, pivot long")
    return materialize(links, "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links lead to, for every node of a link.

    By contraction: every node points to its smallest neighbour, if that is smaller than itself; pointers jump
    to where pointers lead until they stand; links are then drawn between the nodes pointed to, and those
    within one go.  Each round at least halves the nodes that still have links, and a node can't be larger
    than what points to it, so the last one is the smallest of its component.
    """
    whole: DataFrame | None = None
    edges = materialize(links.select(F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y")).where("x < y").distinct(), "edges")
    while True:
        ends = edges.select(F.col("y").alias("v"), F.col("x").alias("p")).unionByName(edges.select(F.col("x").alias("v"), F.col("x").alias("p")))
        points = materialize(ends.groupBy("v").agg(F.min("p").alias("p")), "points")
        while True:
            ahead = points.select(F.col("v").alias("at"), F.col("p").alias("far"))
            jumped = points.join(ahead, points["p"] == ahead["at"]).select("v", F.col("far").alias("p"), (F.col("far") < F.col("p")).alias("moved"))
            jumped = materialize(jumped, "points")
            points = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        if whole is None:
            whole = points.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            root = points.select(F.col("v").alias("component"), F.col("p").alias("root"))
            whole = materialize(whole.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")
        left, right = points.select(F.col("v").alias("x"), F.col("p").alias("a")), points.select(F.col("v").alias("y"), F.col("p").alias("b"))
        drawn = edges.join(left, "x").join(right, "y").where("a <> b")
        edges = materialize(drawn.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "edges")
        if edges.isEmpty():
            return whole


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the column that numbers its rows; no copy is written where the ids do."""
    narrow = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if narrow["rows"] == narrow["ids"]:
        return docs, "doc_id"
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered"), "_row"


def _grouped(docs: DataFrame, number: str, shingle: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id and kept of every row."""
    docs = docs.select(F.col(number).cast("long").alias("row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    sketched = docs.select("row", "doc_id", "text").mapInArrow(_sketcher(shingle), SKETCH)
    rows = materialize(sketched, "sketches")
    least = F.min_by(F.struct("row", "doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(least.alias("x"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select(F.col("x.row").alias("node"), F.col("x.doc_id").alias("doc_id"), "n_shingles", "digest", "sketch"), "classes")

    banded = classes.select("node", "sketch").mapInArrow(_bands, "key long, node long, band int")
    # written, as are the pivots, so that a large bucket's join is of two exchanges, which can be split
    shared = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = materialize(banded.join(shared, "key"), "members")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot"))
    pairs = members.select("key", "node").join(materialize(pivots, "pivots"), "key").where("node != pivot").select("node", "pivot").distinct()
    links = _links(pairs, classes, docs, shingle, percent)

    labels = components(links)
    at = members.select("key", "node", "band").join(labels, "node", "left").select("key", "node", "band", F.coalesce("component", "node").alias("component"))
    mixed = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    more = _links_across(materialize(at.join(materialize(mixed, "mixed"), "key"), "open"), classes, docs, shingle, percent)
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    # written, so that the join with a large component's members is of two exchanges, which can be split
    first = labels.join(classes.select("node", "doc_id"), "node").groupBy("component")
    first = first.agg(F.min("doc_id").alias("component_id"), F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("survivor"))
    found = labels.join(materialize(first, "first"), "component").select("node", "component_id", "survivor")
    named = classes.select("node", "digest", F.col("doc_id").alias("own")).join(found, "node", "left")
    named = named.select("digest", F.coalesce("component_id", "own").alias("component_id"), F.coalesce("survivor", "node").alias("survivor"))
    out = rows.select("row", "doc_id", "n_shingles", "digest").join(named, "digest", "left")
    # a document without words is its own group
    kept = (F.col("n_shingles") == 0) | (F.col("row") == F.col("survivor"))
    return out.select("row", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, *, shingle: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs, number = _numbered(docs.select("doc_id", "text"))
    return _grouped(docs, number, shingle, percent).drop("row")


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each group, the one with the smallest id; of equal ids, the first."""
    docs, as_they_came = set_aside(docs, "doc_id", "text")
    numbered, number = _numbered(docs)
    kept = _grouped(numbered, number, shingle, percent).where("kept").select(F.col("row").alias(number))
    kept = materialize(kept, "kept")
    return as_they_came(numbered.join(small_side(kept), number, "left_semi"))
