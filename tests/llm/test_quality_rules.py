import time
from collections import Counter

from panelforge.llm import common
from panelforge.llm import quality_rules as q

GOOD = "one two three four five six seven eight nine ten eleven twelve"


def brute(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(docs):
    texts = [GOOD, None, "", " \t\n", "a b c d e a b c d e f", "x " * 40, f"{GOOD}\n{GOOD}\n\n{GOOD} #*", "é日 本 x # $\x0bend", "a a a a a a", "w " * 30000, "a b c d e x a b c d e"]
    got = {r.doc_id: r for r in q.quality_rules(docs(*[(i, t, None, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_a_million_repeated_words_take_seconds(docs):
    began = time.time()
    one = q.quality_rules(docs((1, "w " * 1_000_000, None, "s"), (2, " ".join(f"a{i % 1000}" for i in range(300_000)), None, "s"))).collect()
    assert {r.doc_id: r.n_repeat_words for r in one} == {1: 1_000_000, 2: 300_000}
    assert time.time() - began < 90


def test_rules_are_written_before_they_are_filtered(docs, monkeypatch):
    """A filter below the projections would split a text for every window: none may reach the scan of the texts."""
    written = []
    monkeypatch.setattr(q, "materialize", lambda df, name: written.append((name, df)) or common.materialize(df, name))
    left = q.drop_low_quality(docs((1, GOOD, None, "s")))
    plan = written[0][1]._jdf.queryExecution().optimizedPlan().toString()
    assert written[0][0] == "quality-docs" and "Filter" not in plan and "base_failed" in plan
    assert "split(" not in left._jdf.queryExecution().optimizedPlan().toString()


def test_sampling_noise_is_no_difference(spark):
    rows = [(f"h{i}", i % 5 == 0) for i in range(400)]  # one document each: the rates say nothing of hosts
    assert all(not r.host_failed and abs(r.host_rate - (0.2 * 10 + (r.n_failed)) / 11) < 1e-9 for r in q.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect())
    rows = [(f"h{i}", k < (9 if i % 2 else 1)) for i in range(40) for k in range(10)]
    got = {r.host: r for r in q.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert all(r.host_failed == (int(h[1:]) % 2 == 1) for h, r in got.items())
    assert 0.1 < got["h0"].host_rate < 0.2 and 0.8 < got["h1"].host_rate < 0.9


def test_hosts_are_shrunk_and_joined_back(docs):
    rows = [(i, "bad", None, "https://u@Bad.example:80/x?y") for i in range(40)] + [(100, GOOD, None, "http://bad.example/z")]
    rows += [(200 + i, GOOD, None, f"good{i % 5}.example") for i in range(60)] + [(300, GOOD, None, None), (301, GOOD, None, " ")]
    got = {r.doc_id: r for r in q.quality_rules(docs(*rows)).collect()}
    assert got[100].base_failed is False and got[100].kept is False and got[100].host == "bad.example"
    assert all(got[i].kept for i in (200, 259, 300, 301))
    left = q.drop_low_quality(docs(*rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "row", "score"]
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.kept}


def test_repeated_rows_and_empty_table(docs):
    assert q.quality_rules(docs((1, GOOD, None, "a"), (1, GOOD, None, "a"))).count() == 2
    assert q.quality_rules(docs()).count() == 0
    assert q.drop_low_quality(docs()).count() == 0
