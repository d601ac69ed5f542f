import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import mixing


def corpus(n=900):
    rng = np.random.default_rng(2)
    return [(i, "w " * int(rng.integers(1, 300)), None, [None, "a", "b", "c"][min(3, i % 8)]) for i in range(n)] + [(n, None, None, "a"), (n + 1, "", None, "z")]


def targets(sizes):
    """Water filling by hand: shares by weight, capped at three times the size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets_and_taken_words(docs):
    rows = corpus(500)
    table = docs(*rows)
    got = mixing.mix(table).collect()
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    total = {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    want = targets(total)
    taken = {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(300, 0.03 * t), s


def test_the_layout_makes_no_difference(docs):
    rows = corpus(150) + [(5, "same text in two rows", None, "a")] * 5 + [(None, "no id " * 9, None, "b")] * 40 + [(6, "other source", None, "a"), (6, "other source", None, "c")]
    got = lambda t: sorted(map(str, mixing.mix(t).collect()))
    once = got(docs(*rows))
    laid = docs(*reversed(rows)).repartition(7, "text")
    assert got(laid) == once and got(docs(*rows).coalesce(1)) == once
    taken = lambda t: sorted(map(str, mixing.take(t).collect()))
    assert taken(laid) == taken(docs(*rows))
    assert len({r for r in once if "doc_id=None" in r}) == 2  # equal rows are rounded each on their own


def test_many_sources_are_in_order(docs):
    names = [None, *[f"s{i:03d}" for i in range(50)], "é", "Z", "日"]
    got = mixing.mix(docs(*[(i, "w " * (10 + i % 3), None, s) for i, s in enumerate(names)])).collect()
    size = {names[r.doc_id]: r.size for r in got}
    want = targets(size)
    assert all(r.target == pytest.approx(want[names[r.doc_id]]) for r in got)


def test_pivot_keeps_words_and_probabilities():
    rng = np.random.default_rng(0)
    p, size = rng.uniform(0.05, 0.95, 40), rng.integers(1, 50, 40)
    runs = np.array([mixing.pivot(p, size, rng.uniform(size=40)) for _ in range(4000)])
    assert np.abs(runs.mean(axis=0) - p).max() < 0.04
    assert np.abs(runs @ size - p @ size).max() < 1e-6  # the one left open keeps the sum
    assert ((runs > 1e-9) & (runs < 1 - 1e-9)).sum(axis=1).max() <= 1


def test_take_repeats_rows(docs):
    rows = corpus(120) + [(5, "same text", None, "a"), (5, "same text", None, "a")]
    table = docs(*rows)
    taken = mixing.take(table)
    assert taken.columns == table.columns
    plan = mixing.mix(table)
    assert taken.count() == plan.selectExpr("sum(copies)").first()[0]


def test_empty_and_wordless(docs):
    assert mixing.mix(docs()).count() == 0 and mixing.take(docs()).count() == 0
    got = mixing.mix(docs((1, None, None, None), (2, "", None, "s"))).collect()
    assert all(r.taken == 0 and r.target == 0 for r in got)


def test_sources_over_many_partitions(spark):
    """As many range partitions as a large job has; each source has the weight of its place."""
    n = 5000
    sized = spark.range(n).select(F.format_string("s%05d", "id").alias("source"), F.lit(10).cast("long").alias("size"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = targets({f"s{i:05d}": 10 for i in range(n)})
    assert len(got) == n and all(got[s] == pytest.approx(t) for s, t in want.items())
