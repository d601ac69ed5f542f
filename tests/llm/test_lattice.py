import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import lm_scoring
from panelforge.llm import sentencepiece_codec as codec
from panelforge.llm.lattice import LITERAL, MARK, Lattice, entry_scores, exit_states, lattice_of, load_vocabulary, log_sum, max_plus, product_tree, total


@pytest.fixture(scope="module")
def lattice():
    return Lattice(load_vocabulary(codec.MODEL))


def segmentations(lattice, s):
    """Log weights of all ways to write ``s`` in pieces, or bytes where a character is no piece."""
    if not s:
        return [0.0]
    out = [lattice.pieces[s[:e]][1] + w for e in range(1, min(len(s), 16) + 1) if s[:e] in lattice.pieces for w in segmentations(lattice, s[e:])]
    if s[0] not in lattice.pieces:
        out += [lattice.byte_weight * len(s[0].encode()) + w for w in segmentations(lattice, s[1:])]
    return out


@pytest.mark.parametrize("word", ["▁hello", "▁there", "▁a,b", "▁x☃y", "▁▁▁in"])
def test_best_and_sum_match_enumeration(lattice, word):
    ways = segmentations(lattice, word)
    assert lattice.encode_all([word])[0][0] == pytest.approx(max(ways))
    assert lattice.likelihood_all([word])[0] == pytest.approx(math.log(math.fsum(map(math.exp, ways))))
    assert lattice._sum(word) == pytest.approx(lattice.likelihood_all([word])[0])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the▁ \n\té日𝄞-ing"), max_size=60))
def test_round_trip(text):
    lat = Lattice(load_vocabulary(codec.MODEL)) if not hasattr(test_round_trip, "lat") else test_round_trip.lat
    test_round_trip.lat = lat
    _, ids = lat.encode(lat.normalize(text))
    assert lat.decode(ids) == text


TEXTS = ["the cat sat on the mat \n" * 9, "x" * 170, "", "é▁日 " * 30, "abcdefghij" * 12, "=" * 300, "aaaa aaaaaaa" * 20, "-_-_" * 60 + "▁" * 40, " " * 90]


def in_chunks(lattice, text, size):
    s = lattice.normalize(text)
    parts = codec.split_text(s, size, lattice.longest - 1)
    levels = product_tree([lattice.transfer(p, b) for b, p in parts], max_plus)
    traced = [lattice.trace(p, b, v.tolist()) for (b, p), v in zip(parts, entry_scores(levels), strict=True)]
    states = exit_states([x[0] for x in traced])
    return total(levels), [i for (_, shared, tails), j in zip(traced, states, strict=True) for i in shared + tails[j]]


@pytest.mark.parametrize("size", [5, 17, 40, 200])
def test_chunks_give_the_same_pieces(lattice, size):
    for text in TEXTS:
        if text:
            want, ids = lattice.encode(lattice.normalize(text))
            score, got = in_chunks(lattice, text, size)
            assert score == want and got == ids.tolist() and lattice.decode(got) == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aab  =x\n▁é-"), min_size=1, max_size=150), st.sampled_from([3, 19, 33]))
def test_any_text_has_the_same_pieces_in_chunks(text, size):
    lat = test_round_trip.lat if hasattr(test_round_trip, "lat") else Lattice(load_vocabulary(codec.MODEL))
    want, ids = lat.encode(lat.normalize(text))
    assert in_chunks(lat, text, size) == (want, ids.tolist())


@pytest.mark.parametrize("size", [17, 60])
def test_chunks_give_the_same_sums(lattice, size):
    for text in filter(None, TEXTS):
        s = lattice.normalize(text)
        matrices = [lattice.transfer(p, b, True) for b, p in codec.split_text(s, size, lattice.longest - 1)]
        assert total(product_tree(matrices, log_sum)) == pytest.approx(lattice.likelihood_all([s])[0])


def test_arrays_and_loops_break_ties_alike(lattice):
    for word in ["=" * 37, "▁aaaaaaaaaaaaaaa", "-_" * 15, "▁▁▁▁▁▁▁", "xXxXxX"]:
        assert np.frombuffer(lattice._best(word)[1], np.int32).tolist() == lattice.encode(word)[1].tolist()


def test_long_segments_are_not_remembered(lattice):
    lat = Lattice(load_vocabulary(codec.MODEL))
    lat.likelihood_all(["▁" + "ab" * 50 * k for k in range(1, 30)])
    lat.encode_all(["▁" + "ab" * 50 * k for k in range(1, 30)])
    assert not lat.sum_memory and not lat.best_memory


def test_max_plus_is_associative():
    a, b, c = np.random.default_rng(1).normal(size=(3, 5, 5))
    assert np.allclose(max_plus(max_plus(a, b), c), max_plus(a, max_plus(b, c)))


def test_encode_and_decode_tables(docs, lattice):
    texts = ["the cat", None, "", "y" * 700 + " the end. " * 60, "the cat", "a▁b\x00c"]
    table = docs(*[(i, t, None, None) for i, t in enumerate(texts)])
    got = codec.encode(table, "doc_id", chunk=100)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts) and all(r.round_trip for r in rows.values())
    for i, t in enumerate(texts):
        assert rows[i].score == pytest.approx(lattice.encode(lattice.normalize(t or ""))[0])
        assert rows[i].pieces == lattice.encode(lattice.normalize(t or ""))[1].tolist()  # split or whole
    back = {r.doc_id: r.text for r in codec.decode(got, "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert codec.encode(docs(), "doc_id").count() == 0


@pytest.mark.parametrize("rare", [1_000_000, 2])
def test_lm_scores_match_brute_force(docs, lattice, rare):
    texts = ["The cat and the dog", "the the the", "One GIANT text that is split " * 12 + "q" * 90, None, "", "Éa É b", "rare words only here", "the cat", "the cat"] + [f"word{i} the of" for i in range(30)]
    got = {r.doc_id: r for r in lm_scoring.score(docs(*[(i, t, "en", None) for i, t in enumerate(texts)]), rare=rare, chunk=60).collect()}
    split = {i: (t or "").encode().lower().split() + [b" end"] for i, t in enumerate(texts)}
    counts = collections.Counter(w for i, x in split.items() if zlib.crc32(str(i).encode()) % 10 for w in x)
    n, v = sum(counts.values()), len(counts)
    for i, x in split.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(counts[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x))
        low = "".join(c.lower() if c < "\x80" else c for c in texts[i] or "")
        assert r.score == pytest.approx((lattice.likelihood_all([lattice.normalize(low)])[0] + lattice.end_weight) / math.log(10))
    assert lm_scoring.score(docs()).count() == 0


def test_lm_scores_learn_from_the_training_fold(docs, spark):
    """Held-out texts of the fold's words score near their base, split or whole, and a rarer word is scored by learnt pieces."""
    texts = [f"zorbl quantix {'vexal ' * (i % 4)}lorbl{i % 7} zorbl" for i in range(200)] + ["zorbl quantix\nvexal " * 12]
    table = docs(*[(i, t, "en", None) for i, t in enumerate(texts)])
    whole, split = ({r.doc_id: r for r in lm_scoring.score(table, chunk=chunk, words=50).collect()} for chunk in (10_000, 60))
    held = [r for r in whole.values() if r.held_out]
    assert held and all(math.isfinite(r.score) for r in whole.values())
    assert sum(r.score for r in held) > 1.3 * sum(r.base_score for r in held)
    assert all(split[i].score == pytest.approx(r.score) for i, r in whole.items())
    few = {r.doc_id: r.score for r in lm_scoring.score(table, words=1).collect()}  # one piece more: the rest by pieces on best paths
    plain = {r.doc_id: r.score for r in lm_scoring.score(table).collect()}
    assert sum(few.values()) > sum(plain.values())


def test_long_neighbours_are_not_split_at_once():
    texts = pa.array(["a" * 60_000] * 40 + [None, "", "b" * 900_000] + ["c"] * 1200)
    found = list(codec.runs(texts))
    assert [k for at, n in found for k in range(at, at + n)] == list(range(len(texts)))
    sizes = [[len(t or "") for t in texts.slice(at, n).to_pylist()] for at, n in found]
    assert all(len(s) <= 500 and (sum(s) <= codec.TOGETHER or len(s) == 1) for s in sizes) and list(codec.runs(texts[:0])) == []


def test_every_word_counts_for_the_learnt_pieces(spark):
    """No part of the rarer words stands for all, and frequent words that are too long for a piece count by their characters."""
    chars = [MARK, "w", "x", "\n", *"0123456789"]
    table = {"pieces": {p: (i, -4.0) for i, p in enumerate([*chars, "zz"])}, "bytes": {b: 20 + b for b in range(256)}, "byte_weight": -20.0, "end_weight": -4.0}
    n = 250_000
    counts = spark.range(n).selectExpr("cast(concat('w', id) as binary) as word", "1L + id % 2 as c")
    more = spark.createDataFrame([(bytearray(w), c) for w, c in ((b"x" * 5, 9_000), (b"w", 800), (lm_scoring.END, 100), (lm_scoring.LINE, 0), (lm_scoring.SPACE, n + n // 2 + 9_700))], "word binary, c long")
    got = lm_scoring.learnt(table, counts.unionByName(more), words=2)
    found = collections.Counter({"x": 45_000, MARK: 9_000})
    for i in range(n):
        for ch in f"{MARK}w{i}":
            found[ch] += 1 + i % 2
    prior = lm_scoring.PRIOR * sum(found.values()) * math.exp(-4.0)
    for p in "0123456789x":
        assert abs(got["pieces"][p][1] - got["pieces"]["w"][1] - math.log((found[p] + prior) / (found["w"] + prior))) < 1e-6
    assert MARK + "w" in got["pieces"]


def test_tallies_are_those_of_single_paths():
    table = load_vocabulary(codec.MODEL)
    lattice, rng = Lattice(table), random.Random(5)
    words = sorted({MARK + "".join(rng.choices("etaoinshr\u00e9\u4e2d" + LITERAL, k=rng.choice((1, 3, 9, 50)))) for _ in range(400)})
    times, want = [rng.randint(1, 9) for _ in words], collections.Counter()
    for w, n in zip(words, times):
        for i in lattice.encode(w)[1].tolist():
            want[i] += n
    assert lattice.tally(words, times) == want and lattice_of(table) is lattice_of(table)
