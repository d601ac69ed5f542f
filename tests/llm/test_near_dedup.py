import random

import numpy as np
import pytest

from panelforge.llm import near_dedup as nd
from panelforge.llm import setsketch as ss


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts, k):
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), len(sets[i])) for i in ids}


def corpus():
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = {}
    for i in range(60):  # a star: copies near the base, many of them not near each other
        w = list(base)
        for _ in range(rng.randrange(1, 16)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    chain = [f"c{i}" for i in range(100)]
    for i in range(8):  # a chain: each near the next
        texts[100 + i] = " ".join(chain[6 * i :] + [f"n{j}" for j in range(6 * i)])
    for i in range(40):
        texts[200 + i] = " ".join(f"r{rng.randrange(10**6)}" for _ in range(80))
    texts |= {300: None, 301: "", 302: "one", 303: "ONE", 304: "a b", 305: "A  B\n", 306: texts[3].upper(), 307: "x " * 20000}
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_components_match_brute_force(docs, k):
    texts = corpus()
    got = {r.doc_id: r for r in nd.near_duplicates(docs(*[(i, t, None, None) for i, t in texts.items()]), shingle=k).collect()}
    want = brute(texts, k)
    assert {i: (r.component_id, r.n_shingles) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_stage_keeps_one_of_each_group(docs):
    texts = corpus()
    rows = [(i, t, "en", "s") for i, t in texts.items()] + [(0, texts[0], "en", "s")]
    left = nd.drop_near_duplicates(docs(*rows), shingle=2)
    want = brute(texts, 2)
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i in texts if want[i][0] == i)
    assert left.columns == docs().columns
    assert nd.near_duplicates(docs()).count() == 0 and nd.drop_near_duplicates(docs()).count() == 0


def test_same_id_with_different_texts(docs):
    got = nd.near_duplicates(docs((1, "a b c d", None, None), (1, "p q r s", None, None), (2, "p q r s", None, None))).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_null_and_repeated_ids(docs):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-2] + ["x", "y"])
    text = " ".join(base)
    rows = [(None, text), (9, text), (9, text), (None, near), (7, near)]  # one group, its smallest id is 7
    rows += [(None, "alone with no id at all"), (None, None), (None, "")]  # each its own
    rows += [(None, "p q r s t u"), (None, "p q r s t u"), (None, "P  q r s t u")]  # a group without an id
    rows += [(1, "first text of an id"), (1, "quite another text under that"), (1, "quite another text under that")]
    table = docs(*[(i, t, "en", "s") for i, t in rows])
    got = nd.near_duplicates(table).collect()
    assert len(got) == len(rows)
    assert sum(r.component_id == 7 for r in got) == 5
    assert sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in got if r.kept) == sorted(
        [("7", "7", 59), ("None", "None", 5), ("None", "None", 0), ("None", "None", 0), ("None", "None", 5), ("1", "1", 4), ("1", "1", 4)]
    )
    assert all(r.kept is not None for r in got)
    left = [(r.doc_id, (r.text or "").lower().split()) for r in nd.drop_near_duplicates(table, shingle=2).collect()]
    want = [(7, near), (None, rows[5][1]), (None, ""), (None, ""), (None, "p q r s t u"), (1, rows[11][1]), (1, rows[12][1])]
    assert sorted(map(str, left)) == sorted(str((i, t.split())) for i, t in want)


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(50, 50), (60, 61), (61, 60)]
    got = {r.node: r.component for r in nd.components(spark.createDataFrame(links, "node long, pivot long")).collect()}
    assert got == {i: 0 for i in range(41)} | {60: 60, 61: 60}


def test_registers_estimate_similarity_and_merge():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    a, b = x[:700], x[200:]
    r = ss.registers([a, b, x])
    assert np.array_equal(np.maximum(r[0], r[1]), r[2])
    j = len(np.intersect1d(a, b)) / len(x)
    est = ss.similarity(r[:1], r[1:2], np.array([len(a)], float), np.array([len(b)], float))[0]
    assert abs(est - j) < 0.12


@pytest.mark.parametrize("small", [0, 10])
def test_open_buckets_are_compared_whole(docs, monkeypatch, small):
    """Many texts near the threshold, of several sizes, with few members a block: no link may be lost."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "SMALL", small)
    rng = random.Random(9)
    shared = [f"p{i}" for i in range(90)]
    texts = {}
    for i in range(90):  # a passage that all share, with 10 to 30 words of their own: some pairs link, most do not
        own = [f"o{rng.randrange(60)}" for _ in range(rng.randrange(10, 31))]
        texts[i] = " ".join(shared + own)
    got = {r.doc_id: r for r in nd.near_duplicates(docs(*[(i, t, None, None) for i, t in texts.items()])).collect()}
    assert {i: (r.component_id, r.n_shingles) for i, r in got.items()} == brute(texts, 2)
