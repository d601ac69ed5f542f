import random
import zlib

import numpy as np
import pytest

from panelforge.llm import language_id, toxicity

EN = "the of and to in is that it for on with as are this be by from at or an".split()
DE = "der die und das nicht ein eine für mit auf ist dem den von zu im sich des".split()
FR = "le la les de des et un une dans que qui pour par sur avec est au ne pas".split()


def prose(rng, words, n=60):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "en", "ant"]) for _ in range(n))


@pytest.fixture(scope="module")
def many():
    rng = random.Random(1)
    return [(i, prose(rng, (EN, DE, FR)[i % 3]), ("en", "de", "fr")[i % 3], "s") for i in range(240)]


def test_language_id(docs, many):
    odd = [(900, None, "en", None), (901, "12 34 !?", "de", None), (902, "der und die " * 40000, None, None), (903, "", None, None)]
    got = {r.doc_id: r for r in language_id.identify(docs(*many, *odd)).collect()}
    held = [i for i, *_ in many if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out for i in held)
    assert np.mean([got[i].lang_pred == many[i][2] for i in held]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 903))
    assert got[902].lang_pred == "de" and 0 <= got[902].score <= 1
    assert language_id.identify(docs()).count() == 0
    assert language_id.identify(docs((1, "text", None, None))).first().lang_pred == "und"


def ppm(counts, symbols, context, byte):
    """Probability of a byte by method C with exclusion, by recursion over dictionaries; ``symbols``: equal shares at the end."""
    if context is None:
        return 1 / symbols
    shorter = context[1:] if context else None
    seen = {b: n for (c, b), n in counts.items() if c == context}
    if not seen:
        return ppm(counts, symbols, shorter, byte)
    room = 1 - sum(ppm(counts, symbols, shorter, b) for b in seen)
    whole = sum(seen.values()) + (len(seen) if room > 1e-12 else 0)
    if byte in seen:
        return seen[byte] / whole
    return len(seen) / whole * ppm(counts, symbols, shorter, byte) / room


def test_code_lengths_match_the_recursion(docs):
    texts = {"x": ["abracadabra", "abra", "cab a"], "y": ["banana band", "nab"]}
    model = language_id.train(docs(*[(i, t, lang, None) for lang, some in texts.items() for i, t in enumerate(some, len(lang) * 10)]))
    assert model.langs == ["x", "y"] and model.symbols == 1 + len(set("".join(sum(texts.values(), []))))
    for lang, column in (("x", 0), ("y", 1)):
        counts = {}
        for t in texts[lang]:
            padded = "\n\n\n" + t
            for i in range(3, len(padded)):
                for k in range(4):
                    key = (padded[i - k : i], padded[i])
                    counts[key] = counts.get(key, 0) + 1
        for text in ("abracadabra", "banana", "zebra cab", "a", "nn na ba"):
            padded = "\n\n\n" + text
            want = -sum(np.log2(ppm(counts, model.symbols, padded[i - 3 : i], padded[i])) for i in range(3, len(padded)))
            assert model.lengths(text)[column] == pytest.approx(want, rel=1e-5), (lang, text)


def test_code_lengths_are_a_distribution_and_the_memory_changes_nothing(docs, many):
    model = language_id.train(docs(*many))
    for before in (b"the", b"qqq", b"\n\n\n", b"sch"):
        base = np.uint64(int.from_bytes(before, "big") << 8)
        seen = np.flatnonzero(model.seen).astype(np.uint64)
        unseen = np.uint64(np.flatnonzero(~model.seen)[0])
        bits = model.bits(base | np.append(seen, unseen))
        assert np.allclose(np.exp2(-bits).sum(axis=0), 1, atol=1e-4)
    small = language_id.Model.__new__(language_id.Model)
    small.__setstate__(model.__getstate__())
    small.shift, small.met, small.known = np.uint64(62), small.met[:4].copy(), small.known[:4].copy()
    for _, text, _, _ in many[:20]:
        assert np.allclose(small.lengths(text), model.lengths(text)) and np.allclose(model.lengths(text), model.bits(language_id.grams(text)).sum(axis=0), rtol=1e-5)


def test_repeated_rows_and_ties(docs):
    rows = [(1, "abc abc", "p", None), (1, "abc abc", "p", None), (3, "abc abc", "o", None), (3, "abc abc", "o", None)]
    assert {r.lang_pred for r in language_id.identify(docs(*rows)).collect()} == {"o"}  # equal lengths: the first by code point


def brute_kernel(s, t, lam, n=3):
    from itertools import combinations

    def feats(w):
        out = {}
        for idx in combinations(range(len(w)), n):
            key = "".join(w[i] for i in idx)
            out[key] = out.get(key, 0) + lam ** (idx[-1] - idx[0] + 1)
        return out

    a, b = feats(s), feats(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_matches_enumeration():
    pairs = [("idiot", "idixot"), ("moron", "mooron"), ("abc", "xyz"), ("loser", "loser"), ("aaaa", "aaa")]
    got = toxicity.kernel(toxicity.code([a for a, _ in pairs]), toxicity.code([b for _, b in pairs]))
    assert np.allclose(got, [brute_kernel(a, b, toxicity.DECAY) for a, b in pairs], rtol=1e-4)


def test_all_kernels_above_the_least_are_found():
    rng = random.Random(7)
    landmarks = ["idiot", "scumbag", "moron", "aaaa", "abcabcabcabc", "dumkopf", "日本語話"]
    features = toxicity.Features(landmarks)
    words = {"idiot", "i", "ab", "aaa", "aaaaaaaaaaaaaaaaaaaa", "abcabc"}
    for x in landmarks:
        for _ in range(80):
            w = list(x)
            for _ in range(rng.randrange(4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice("aeioxyz日"))
            rng.random() < 0.3 and rng.shuffle(w)
            words.add("".join(w)[: toxicity.WINDOW])
    for n in {len(w) for w in words}:
        some = sorted(w for w in words if len(w) == n)
        w, m, value = features.near(toxicity.code(some))
        got = {(some[i], landmarks[j]): v for i, j, v in zip(w, m, value, strict=True)}
        for a in some:
            for b in landmarks:
                k = brute_kernel(a, b, toxicity.DECAY)
                want = (k / max(1e-30, brute_kernel(a, a, toxicity.DECAY) * brute_kernel(b, b, toxicity.DECAY)) ** 0.5) ** toxicity.POWER
                if abs(want - toxicity.LEAST_KERNEL) > 1e-4:
                    assert ((a, b) in got) == (want > toxicity.LEAST_KERNEL), (a, b, want)
                if (a, b) in got:
                    assert got[a, b] == pytest.approx(want, abs=2e-3)


def test_rare_insults_are_covered():
    telling = [("common", 4.0, list(range(1000)))] + [(f"{c}{d}zq{c}", 2.0, [1000 + 3 * k, 1001 + 3 * k, 1002 + 3 * k]) for k, (c, d) in enumerate((a, b) for a in "abcdefgh" for b in "klmnop")]
    assert set(toxicity.cover(telling)) == {w for w, _, _ in telling} and toxicity.cover([]) == []


def test_toxicity_of_many_rare_insults(docs, spark):
    rng = random.Random(11)
    bad = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    rows, labels = [], []
    for i in range(1500):
        w, toxic = prose(rng, EN, 30).split(), i % 3 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), bad[(i // 3) % 60])
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += rows[:5]  # repeated rows
    got = toxicity.score(docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95


def test_spaced_and_marked_words():
    assert "idiot" in toxicity.tokens("you i d i o t there") and toxicity.letters("i-d.i_ot!") == "idiot"


def test_toxicity(docs, spark):
    rng = random.Random(3)
    bad = ["idiot", "moron", "scumbag"]
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, EN, 50).split()
        toxic = i % 4 == 0
        if toxic:
            for x in rng.sample(bad, 2):
                w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None, None), (901, "", None, None), (902, "you i d i o t and m-o-r-o-n and scummbag " + "the of and " * 30000, None, None)]
    labels += [(3, None, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs(*rows), table).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [i for i in range(400) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert got[900].predicted == 0 and got[900].score == got[901].score and got[902].predicted == 1
    left = toxicity.drop_toxic(docs(*rows), table)
    assert left.columns == docs().columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.score(docs(), table).count() == 0
    none = table.where("toxic = 0")
    assert all(r.score == 0 for r in toxicity.score(docs(*rows[:20]), none).collect())
