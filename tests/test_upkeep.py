"""Repaired intervals, read-through predictions, the registry and checked parameters."""

from datetime import date, timedelta
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.parameters import Backtest, backtest_errors
from panelforge.operators import contexts as ctx
from panelforge.operators import serving

MONTHS = "date date, pmi long, non_pmi long, cpi10 long"


def month(k):
    return date(2020 + k // 12, k % 12 + 1, 1)


def test_a_repair_equals_a_rebuild_and_writes_only_what_changed(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        old = {k: None if rng.random() < 0.2 else int(rng.integers(45, 56)) for k in range(14) if rng.random() < 0.9}
        new = {k: (None if rng.random() < 0.3 else int(rng.integers(45, 56))) if rng.random() < 0.25 else old.get(k) for k in range(14) if k in old or rng.random() < 0.5}
        table = lambda x: spark.createDataFrame([(month(k), p, 50 + k % 5, 20 + k) for k, p in x.items()], MONTHS)
        stored, want = ctx.history(table(old)), sorted(map(tuple, ctx.history(table(new)).collect()))
        changed = spark.createDataFrame([(month(k),) for k in set(old) | set(new) if old.get(k) != new.get(k)], "date date")
        changes = ctx.patch(stored, table(new), changed)
        assert sorted(map(tuple, ctx.applied(stored, changes).collect())) == want
        before = {r.starts_at: tuple(r) for r in stored.collect()}
        after = {r[0]: r for r in want}
        touched = {d for d in before.keys() | after.keys() if before.get(d) != after.get(d)}
        assert {r.starts_at for r in changes.collect()} == touched
    assert ctx.patch(stored, table(old), changed.limit(0)).count() == 0


def test_a_second_call_computes_nothing(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    calls = []

    def compute(missing):
        calls.append(sorted(r.k for r in missing.collect()))
        return missing.where("k < 10").withColumn("v", F.concat(F.lit("v"), F.col("k").cast("string")))

    ask = lambda *ks: {r.k: r.v for r in serving.read_through(spark.createDataFrame([(k,) for k in ks], "k long"), f"file://{tmp_path}/store", ["k"], schema, compute).collect()}
    assert ask(1, 2, 2, None) == {1: "v1", 2: "v2"}
    assert ask(2, 3) == {2: "v2", 3: "v3"}
    assert ask(1, 2, 3) == {1: "v1", 2: "v2", 3: "v3"}
    assert calls == [[1, 2], [3]]
    assert ask(1, 99) == {1: "v1"}  # nothing is known of 99


def test_one_version_is_active_after_any_order_of_writes(spark, tmp_path):
    rows = [("a", "v1", 1, "READY", 0.5), ("a", "v2", 2, "READY", 0.6), ("a", "v3", 3, "FAILED", 0.1), ("a", "v1", 2, "READY", 0.7), ("b", "v9", 1, "FAILED", None)]
    want = None
    for n, order in enumerate(permutations(range(5))):
        if n % 30:
            continue
        folder = f"file://{tmp_path}/{n}"
        for at in order:
            serving.append(spark.createDataFrame([rows[at]], serving.REGISTRATION), folder)
        got = sorted(map(tuple, serving.registry(serving.stored(spark, folder, serving.REGISTRATION)).collect()))
        assert [r[:2] for r in got if r[-1]] == [("a", "v2")]  # of equal times the greater version
        assert want is None or got == want
        want = got
    ranks = serving.importance_snapshot(spark.createDataFrame([("a", "v1", f, i) for f, i in (("x", 1.0), ("y", 3.0), ("w", 1.0))], "family string, version string, feature string, importance double"))
    assert [(r["feature"], r["rank"]) for r in ranks.orderBy("rank").collect()] == [("y", 1), ("w", 2), ("x", 3)]


def test_checked_rows_say_what_the_checks_of_one_say(spark):
    day = date(2024, 1, 1)
    runs = [(day, day + timedelta(e), c, s, f, h, t) for e in (0, 1) for c in (0.0, 1.0) for s in (0, 100) for f in (0.0, 1.0) for h in (3, 5) for t in (0, 1)]
    table = spark.createDataFrame(runs, "start date, end date, capital double, slots int, fraction double, horizon int, top int")
    got = [r.wrong for r in table.coalesce(1).select(backtest_errors().alias("wrong")).collect()]
    assert got == [Backtest(a, b, c, s, f, h, "bottom", t).checked() for a, b, c, s, f, h, t in runs]
