import corpus_pipeline as cp
from panelforge.llm.sentencepiece_codec import decode


def test_stages_change_and_keep(docs, tmp_path, spark):
    clean = [(i, " ".join(f"word{(i * 31 + k * k) % 997}x{i}" for k in range(60)), "en", f"host{i % 3}") for i in range(30)]
    copies = [(100 + i, clean[i][1] + " tail", "en", "host0") for i in range(5)]
    short = [(200, "too short", "en", "host1"), (201, None, "en", None)]
    table = docs(*clean, *copies, *short)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES:
        frame = cp.materialize(stage(spark, frame, str(tmp_path)), "stage")
        seen.append((name, {r.doc_id for r in frame.select("doc_id").collect()}))
        if name != cp.STAGES[-1][0]:
            assert frame.columns == table.columns
    assert len(cp.STAGES) == 5
    assert seen[0][1] == {r[0] for r in clean + copies + short}
    assert seen[1][1] == {r[0] for r in clean + copies}
    assert seen[2][1] == {r[0] for r in clean}
    assert seen[3][1] <= seen[2][1] and seen[4][1] == seen[3][1]
    assert all(r.round_trip for r in frame.collect())


def written(docs, tmp_path, spark, rows, labels):
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return cp.run(spark, str(tmp_path))


def test_odd_rows(docs, tmp_path, spark):
    text = lambda i, n=60: " ".join(f"word{(i * 31 + k * k) % 997}x{i}" for k in range(n))
    rows = [(i, text(i), "en", "a") for i in range(12)]
    rows += [(i, f"you are a stupid scumbag {text(i)} moron", "en", "b") for i in range(20, 32)]  # toxic
    rows += [(3, rows[3][1], "en", "a"), (None, text(50), None, None), (None, text(51), None, None), (7, text(52), "en", "a"), (60, text(60, 40_000), "en", None), (61, None, "en", "a"), (62, "", None, "a")]
    labels = [(i, 1, int(i >= 20)) for i in [*range(12), *range(20, 32)]]
    out = written(docs, tmp_path, spark, rows, labels)
    got = [(r.doc_id, r.text) for r in decode(out, "doc_id").collect()]
    kept = {r[1] for r in rows[:12]} | {text(50), text(51), text(52), text(60, 40_000)}
    assert {t for _, t in got} <= kept and all(got.count(x) <= 3 for x in set(got))
    assert all(r.round_trip for r in out.collect())


def test_empty_table(docs, tmp_path, spark):
    assert written(docs, tmp_path, spark, [], []).count() == 0


CLASHING = ["_host", "_row", "_copy", "_copies", "score", "_score", "row", "node", "_text", "source_size", "kept", "_kept0", "host", "a.b"]


def test_columns_of_any_name_go_along(tmp_path, spark):
    text = lambda i, n=60: " ".join(f"word{(i * 31 + k * k) % 997}x{i}" for k in range(n))
    rows = [(i, text(i), "en", "a" if i % 2 else None, *[f"{c} {i}" for c in CLASHING]) for i in [*range(20), 3]]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        frame = cp.materialize(stage(spark, frame, str(tmp_path)), "stage")
        assert frame.columns == ["doc_id", "text", "lang", "source", *CLASHING], name
        got = {tuple(r) for r in frame.collect()}
        assert got and got <= set(rows), name
    assert cp.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()
