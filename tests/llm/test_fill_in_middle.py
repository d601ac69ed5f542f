"""Piece table against cutting by a regular expression, and round trips."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import fill_in_middle as fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
TEXTS = ["", None, "a", "one two", "Zeile\nzwei  drei!", "naïve café – ǅ 日本語 🙂x", "<P>", "x <S> y", "<M", "a" * 5000 + "9", "\x00\x7f ab", "  ", "ée"]


def by_hand(doc_id, text):
    """n, form, prefix_chars, middle_chars and output by the contract."""
    text = text or ""
    units = UNIT.findall(text)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_document_by_hand(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "form", -1) for i in range(400)] + [(None, "some text", "f", 1), (3, TEXTS[3], "form", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long")
    got = fim.fill_in_middle(docs)
    assert got.columns == ["doc_id", *fim.RESULTS]
    want = []
    for doc_id, text, *_ in rows:
        *numbers, output = by_hand(doc_id, text)
        want.append((doc_id, *numbers, sha(output), sha(text or ""), output))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = {(r["doc_id"], r["text"]) for r in fim.restore(got).collect()}
    assert back == {(i, t or "") for i, t, *_ in rows}
    assert fim.fill_in_middle(docs, with_output=False).drop("doc_id").columns == list(fim.RESULTS[:-1])
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_extra_columns_and_a_long_text(spark):
    long = "word 1, 日本 " * 300_000
    docs = spark.createDataFrame([(5, long, "kept")], "doc_id long, text string, output_ string")
    row = fim.fill_in_middle(docs, columns=("output_", "doc_id")).first()
    n, form, p, m, output = by_hand(5, long)
    assert (row["output_"], row["doc_id"], row["n"], row["form"], row["prefix_chars"], row["middle_chars"]) == ("kept", 5, n, form, p, m)
    assert row["output"] == output and row["restored_sha256"] == sha(long)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ \n.<PSM>é🙂"), max_size=40), st.integers(0, 50), st.integers(0, 50), st.sampled_from(["psm", "spm"]))
def test_round_trip(text, a, b, form):
    data = memoryview(text.encode())
    starts = fim.units(data)
    units = UNIT.findall(text)
    assert len(starts) == len(units)
    a, b = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    table = fim.transformed(data, form, a, b, starts)
    output = b"".join(table.stream())
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    assert output.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert table.hash() == hashlib.sha256(output).hexdigest()
    if not any(mark in text for mark in ("<P>", "<S>", "<M>")) and not {"<P", "<S", "<M"} & {x[-2:] for x in (p, m, s)}:
        assert b"".join(fim.restored(output, form).stream()).decode() == text
