"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a share of all words; target / source size is how often each of its documents is wanted.
The whole part is taken outright and the fraction is rounded by the pivotal method: two documents meet, and
words move at random from one to the other until one of them is 0 or 1, which keeps every document's
probability and the expected words of the two.

Heads, the documents with a 1 / ``HEAD`` part of their source or more (``HEAD`` a source at most), are rounded
first.  The words by which they miss their share are dealt to the source's other documents, which all become
a little more or less probable, so that no large document decides whether a target is met.

Within a task the documents of one leaf (a source, a class of sizes, a salt where the class is large) are rounded
in order; the one unsettled document of a leaf goes up a reduction tree, where those of ``FAN_IN`` neighbouring
leaves are rounded the same way, level by level, until a source has one left, settled by its probability.

Defined cases
- null text: size 0, its copies count no words; null source: a source of its own, last in order;
- repeated rows: each is rounded on its own; ties of size are ordered by a hash of id, source and text;
- a source without words: target 0, nothing taken; an empty table: an empty result;
- reruns agree, however the table is laid out: all randomness is a hash of id, source, text and ``SEED``, and of a number
  that only tells fully equal rows apart, which are counted through; sums are over whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, partitions, set_aside, small_side

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
SEED = 20240501
#: Documents in a leaf, about, and leaves that meet in one task of the tree.
LEAF = 400
FAN_IN = 64
#: Classes of sizes: sixteen to a doubling.
CLASSES = 16 * 64
EPS = 1e-9
HEAD = 40
#: Parts of a word in which sums are taken, so that their order makes no difference.
UNITS = 1 << 20


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words, and a hash that orders ties."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "row",
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("tie"),
    )


def _through(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... through the rows of equal ``keys`` in the order of the written column ``row``.

    Rows are numbered within their writing task and begin where the tasks before ended, so no task holds all rows of
    one key; the window over tasks has one row a task and key.
    """
    df = df.withColumn("_task", F.shiftright(F.col("row"), 33))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_task").orderBy("row")) - 1
    return df.withColumn("_in", inside).join(starts, [*keys, "_task"]).withColumn(name, F.col("_in") + F.col("_start")).drop("_in", "_start", "_task")


def told_apart(sized: DataFrame) -> DataFrame:
    """``tie`` of fully equal rows mixed with their number; which of them gets which number makes no difference."""
    equal = sized.groupBy("tie").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("tie")
    again = _through(sized.select("tie", "row").join(equal, "tie", "left_semi"), "_k", "tie").where("_k > 0")
    again = materialize(again.select("row", F.xxhash64("tie", "_k").alias("_tie")), "equal-rows")
    return sized.join(again, "row", "left").withColumn("tie", F.coalesce("_tie", "tie")).drop("_tie")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: shares by weight of all words, none above ``MOST_COPIES`` times its source.

    Each round deals what is left among the sources below their cap in proportion to weight, and caps those
    that would pass it; the driver sees three sums a round.  The table has one row a source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # numbered in order without one task for all: ranges in order, each sorted, and where each begins
    sorted_ = sources.repartitionByRange(partitions(sized), F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    sorted_ = materialize(sorted_.withColumn("at", F.monotonically_increasing_id()), "sources")
    task = F.shiftright(F.col("at"), 33)
    starts, start = [], 0
    for r in sorted_.groupBy(task.alias("task")).count().orderBy("task").collect():  # as many as there are partitions
        starts.append((r["task"], start))
        start += r["count"]
    begins = F.broadcast(sized.sparkSession.createDataFrame(starts, "task long, start long"))
    sorted_ = sorted_.join(begins, task == F.col("task"))
    place = (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place + 1).cast("int"))
    sources = materialize(sorted_.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST_COPIES).alias("cap")), "sources")
    total = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    rate = 0.0
    while True:
        full = F.col("weight") * F.lit(rate) >= F.col("cap")
        capped, weights = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        after = (total - capped) / weights if weights else rate
        if after <= rate * (1 + 1e-12):
            break
        rate = after
    return sources.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(rate)).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round the probabilities in order; at most one stays between 0 and 1.  ``u``: a random number each.

    A step moves words between the document held and the next, up or down with the odds that keep both
    probabilities, as far as one of them can go.
    """
    p, size = p.tolist(), np.maximum(size, 1).tolist()
    held = -1
    for i, b in enumerate(p):
        if b <= EPS or b >= 1 - EPS:
            p[i] = float(round(b))
            continue
        if held < 0:
            held = i
            continue
        a, ratio = p[held], size[i] / size[held]
        up, down = min(1 - a, b * ratio), min(a, (1 - b) * ratio)
        move = up if u[i] * (up + down) < down else -down
        p[held], p[i] = a + move, b - move / ratio
        free = []
        for k in (held, i):
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = float(round(p[k]))
            else:
                free.append(k)
        held = free[0] if free else -1
    return np.array(p)


def _uniform(ids: np.ndarray, level: int) -> np.ndarray:
    """A number in [0, 1) from each id, the level and SEED."""
    x = ids.astype(np.int64).view(np.uint64) ^ np.uint64(SEED * 1_000_003 + level)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _round(level: int):
    def run(group: pa.Table) -> pa.Table:
        size, tie = group.column("size").to_numpy(), group.column("tie").to_numpy()
        order = np.lexsort((tie, size))
        group = group.take(pa.array(order))
        p = pivot(group.column("p").to_numpy(), size[order], _uniform(tie[order], level))
        return group.select(NAMES[:-1]).append_column("p", pa.array(p))

    return run


ROUNDED = "row long, source_no long, band long, salt long, size long, tie long, p double"
NAMES = [x.split()[0] for x in ROUNDED.split(", ")]


def _part(wanted: Column) -> Column:
    return F.greatest(wanted - F.floor(wanted + EPS), F.lit(0.0))


def _settle() -> Column:
    """0 or 1 by the probability p, from the row's own hash."""
    chance = F.pmod(F.xxhash64("tie", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.when(chance < F.col("p"), 1.0).otherwise(0.0)


def copies(docs: DataFrame) -> DataFrame:
    """row, doc_id, size, source_size, target and copies (long) of every row; ``docs`` has a unique ``row``."""
    sized = materialize(told_apart(materialize(sizes(docs), "sizes")), "sizes")
    goal = targets(sized).withColumn("source_no", F.xxhash64("source"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("wanted")
    known = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).select("row", "doc_id", "size", "tie", "source_no", "source_size", "target", wanted)
    is_head = F.col("size") * HEAD >= F.greatest("source_size", F.lit(1))
    heads = known.where(is_head).withColumns({"band": F.lit(0).cast("long"), "salt": F.lit(0).cast("long"), "p": _part(F.col("wanted"))})
    heads = materialize(heads.groupBy("source_no").applyInArrow(_round(100), ROUNDED), "heads")
    heads = heads.withColumn("p", _settle())
    missed = known.join(heads.select("row", "p"), "row").groupBy("source_no").agg(F.sum(F.round((F.col("p") - _part(F.col("wanted"))) * F.col("size") * UNITS).cast("long")).alias("excess"))
    rest = known.where(~is_head).groupBy("source_no").agg(F.sum("size").alias("rest"))
    shift = materialize(missed.join(rest, "source_no").select("source_no", (F.col("excess") / F.lit(UNITS) / F.greatest("rest", F.lit(1))).alias("shift")), "shift")
    moved = F.when(is_head, F.col("wanted")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(MOST_COPIES), F.col("wanted") - F.coalesce("shift", F.lit(0.0)))))
    known = known.join(shift, "source_no", "left").withColumn("wanted", moved).withColumns({"head": is_head, "whole": F.floor(F.col("wanted") + EPS), "p": _part(F.col("wanted"))})
    known = materialize(known.withColumn("band", F.floor(F.log2(F.col("size") + F.lit(1.0)) * 16).cast("long")), "known")
    counts = known.groupBy("source_no", "band").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("salts"))
    counts = materialize(counts, "leaves")  # a few hundred rows a source
    salts = counts.agg(F.coalesce(F.max("salts"), F.lit(1))).first()[0]
    left = known.where((F.col("p") > EPS) & ~F.col("head")).join(counts, ["source_no", "band"])
    left = left.withColumn("salt", F.pmod(F.xxhash64("tie"), F.col("salts"))).select("row", "source_no", "band", "salt", "size", "tie", "p")

    settled = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
    classes, level, done = CLASSES, 0, []
    while True:
        current = materialize(left.groupBy("source_no", "band", "salt").applyInArrow(_round(level), ROUNDED), "rounded")
        done.append(current.where(settled))
        left = current.where(~settled)
        level += 1
        if salts > 1:
            left, salts = left.withColumn("salt", F.floor(F.col("salt") / FAN_IN)), -(-salts // FAN_IN)
        elif classes > 1:
            left, classes = left.withColumn("band", F.floor(F.col("band") / FAN_IN)), -(-classes // FAN_IN)
        else:
            break
    rounded = left.withColumn("p", _settle()).unionByName(heads)
    for part in done:
        rounded = rounded.unionByName(part)
    extra = rounded.where("p > 0.5").select("row", F.lit(1).alias("extra"))
    number = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies")
    return known.join(extra, "row", "left").select("row", "doc_id", "size", "source_size", "target", number)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    plan = copies(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns it came with."""
    docs, as_they_came = set_aside(docs, "doc_id", "source", "text")
    narrow = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if narrow["rows"] == narrow["ids"]:
        numbered = docs.withColumn("_row", F.col("doc_id").cast("long"))
    else:  # ids that repeat, or are null: rows need numbers of their own, which a written copy keeps
        numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    plan = copies(numbered.select(F.col("_row").alias("row"), "doc_id", "source", "text")).where("copies > 0")
    plan = materialize(plan.select(F.col("row").alias("_row"), F.col("copies").alias("_copies")), "plan")
    taken = numbered.join(small_side(plan), "_row")
    return as_they_came(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))
