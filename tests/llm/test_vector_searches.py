"""Hard negatives and space-filling curves against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm import curves, hard_negatives

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("row", "a", "family", "chunk", "block", "score", "line", "key", "x")]
)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, *"abcdefghi") for i, v, lab in rows], SCHEMA)


def taking_part(rows, zero=True):
    return [(i, v, lab) for i, v, lab in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))]


def mined(rows, every, positives=5, k=3, low=50, high=95):
    """Every pair, by the contract."""
    able = [(i, [int(np.floor(256 * c)) for c in v], lab) for i, v, lab in taking_part(rows) if lab is not None]
    out = []
    for own, q, label in {(i, tuple(v), lab) for i, v, lab in able if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i, lab) for i, v, lab in able if i != own and len(v) == len(q))
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            found = [(-n, nid) for n, nid, lab in scored if lab != label and low * -p <= 100 * -n and 100 * -n <= high * -p][:k]
            out += [(own, pid, r + 1, nid, -p, n) for r, (n, nid) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(3, 4))
    rows = [(i, (middle[i % 3] + rng.normal(size=4)).round(2).tolist(), 1 if i % 3 == 0 else i % 4) for i in range(240)]
    rows += [(1000 + i, rows[6][1], 1 if i % 2 else 2) for i in range(80)]  # one vector that many rows share
    rows += [(7, rows[7][1], rows[7][2]), (30, rows[30][1], rows[30][2]), (10, [1.0, 2.0, 3.0, 4.0], 9)]  # repeated rows, an id with two vectors
    rows += [(None, [1.0] * 4, 1), (2000, None, 1), (2010, [1.0, None, 0.0, 0.0], 1), (2020, [float("nan")] * 4, 2), (2030, [1.0] * 4, None), (2040, [1.0, 1.0], 1), (2050, [], 1), (2060, [0.0] * 4, 2)]
    return rows


@pytest.mark.parametrize("size", [None, 40])
def test_hard_negatives_are_those_of_all_pairs(spark, vectors, size):
    got = hard_negatives.mine(table(spark, vectors), every=10, size=size)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows_of(got) == mined(vectors, 10)


def test_hard_negatives_without_negative_scores_and_without_rows(spark):
    rows = [(0, [1.0], 1), (1, [-1.0], 1), (2, [0.0], 1), (3, [0.0], 2), (4, [-0.7], 2)]
    got = rows_of(hard_negatives.mine(table(spark, rows), every=10))
    assert got == mined(rows, 10) == [(0, 2, 1, 3, 0, 0)]  # 0 has the window 0 to 0, a positive below 0 has none
    assert hard_negatives.mine(table(spark, [])).collect() == []
    assert hard_negatives.mine(table(spark, [(0, [1.0], 1), (1, [1.0], 1)])).collect() == []


def test_scores_are_exact_beyond_doubles_and_end_with_a_long(spark):
    rows = [(0, [2.0**21, 1.0], 1), (1, [2.0**21, 3.0], 1), (2, [2.0**21 * 0.75, 7.0], 2), (3, [2.0**21 * 0.75, 8.0], 2)]
    assert rows_of(hard_negatives.mine(table(spark, rows), every=10)) == mined(rows, 10)
    asked, points = np.array([[2.0**40]]), np.array([[2.0**40], [-(2.0**40)], [2.0**14]])
    assert hard_negatives.scores(asked, points).tolist() == [[hard_negatives.LIMIT, -hard_negatives.LIMIT, 2**54]]


def test_slots_answer_overlapping_windows():
    upper, least = hard_negatives.limits([100, 80, 100, -5, 41], 50, 95)
    assert upper == [95, 76, 38] and least == 21
    pick = hard_negatives._negatives(2, 50, 95)
    score, ids = np.array([96.0, 95, 90, 77, 76, 60, 38, 21, 20]), np.arange(9)
    found = {s: r.tolist() for s, r in pick(score, ids, np.zeros(9, int), -1, 1, [100, 80, 41])}
    assert found == {0: [1, 2], 1: [4, 5], 2: [6, 7]}


def test_labels_of_any_type(spark, vectors):
    text = table(spark, vectors).withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))
    assert rows_of(hard_negatives.mine(text, every=10)) == mined(vectors, 10)


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (5, 2)])
def test_hilbert_visits_each_cell_once_and_only_neighbours_in_turn(axes, bits):
    cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * axes)], axis=1)
    keys = curves.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << (axes * bits)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def true_nearest(rows, every, k):
    able = taking_part(rows, zero=False)
    out = {}
    for own, q in {(i, tuple(v)) for i, v, _ in able if i % every == 0}:
        out.setdefault(own, []).extend(sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v, _ in able if i != own and len(v) == len(q))[:k])
    return {q: sorted(found)[:k] for q, found in out.items() if found}


def test_curves_find_all_on_a_small_table_with_equal_vectors(spark, vectors):
    """A window of the sample's resolution covers a small table, so all is found; ties by id, nulls and zeros take no part."""
    want = true_nearest(vectors, 10, 7)
    got = {}
    found = curves.nearest(table(spark, vectors), every=10, k=7, aim=1.0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    for q, rank, i, d in rows_of(found):
        got.setdefault(q, []).append((d, i))
        assert rank == len(got[q])
    assert set(got) == set(want)
    whole = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(len(set(w)) for w in want.values())
    assert whole >= 0.97
    alike = [q for q in want if 1000 <= q < 1080]
    assert alike and all(got[q] == want[q] for q in alike)
    assert curves.nearest(table(spark, []), every=10).collect() == []


@pytest.mark.parametrize("kind", ["noise", "few directions", "one direction"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    of = {"noise": 24, "few directions": 3, "one direction": 1}[kind]
    x = rng.normal(size=(4000, of)) @ rng.normal(size=(of, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = curves.nearest(df, every=40).cache()
    assert curves.recall(df, found, every=40) >= 0.93
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0


def test_windows_follow_the_data():
    near, wide = np.full((32, 100), 1e-4), np.full((32, 100), 0.2)
    assert curves.choose(near, 10**7, 20_000, 100, 0.97) == (4, 2500)
    assert curves.choose(wide, 10**4, 20_000, 100, 0.97)[0] == 4
    falling = np.linspace(0.3, 0.01, 32)[:, None] * np.ones((32, 100))
    assert curves.choose(falling, 10**7, 20_000, 100, 0.97)[0] == 32


def test_distances_beyond_squares():
    d = curves.distances(np.array([1e200, 0.0]), np.array([[0.0, 0.0], [1e200, 1e200], [-1.5e308, 0.0]]))
    assert np.allclose(d[:2], 1e200) and d[2] > 1e308
