"""Wide rows are not shuffled again, and what training reads is worked out once."""

import re
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge.operators import pointintime as pit
from panelforge.operators import sequences as sq
from panelforge.plans import models
from panelforge.plans.joins import with_label

DAY = date(2024, 1, 1)
DATA = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan.split("== Initial Plan ==")[-1]))


def test_several_sides_at_once_are_the_same_as_one_after_the_other(spark):
    rng = np.random.default_rng(3)
    make = lambda n, name: spark.createDataFrame([(int(rng.integers(4)), DAY + timedelta(int(i)), float(rng.normal())) for i in rng.permutation(60)[:n]], f"k long, t date, {name} double")
    left, a, b = make(30, "x").cache(), make(9, "a").cache(), make(7, "b").cache()
    both = pit.asof_each(left, "k", "t", (a, "t", ("a",)), (b, "t", ("b",)))
    one = pit.asof(pit.asof(left, a.withColumnRenamed("t", "u"), "k", "t", "u", "a"), b.withColumnRenamed("t", "u"), "k", "t", "u", "b")
    assert both.columns == one.columns == ["k", "t", "x", "a", "b"] and both.schema == one.schema
    newest = lambda r, side, v: next((s[v] for s in sorted(side, key=lambda s: s.t, reverse=True) if s.k == r.k and s.t <= r.t), None)
    fa, fb = a.collect(), b.collect()
    want = sorted((r.k, r.t, r.x, newest(r, fa, "a"), newest(r, fb, "b")) for r in left.collect())
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, one.collect())) == want


def test_windows_after_an_asof_need_no_shuffle(spark):
    x = spark.range(40).select((F.col("id") % 4).alias("k"), F.col("id").alias("t"))
    joined = pit.asof(x, x.withColumn("y", F.col("t")), "k", "t", "t", "y")
    from pyspark.sql import Window

    assert exchanges(joined.withColumn("z", F.lag("y").over(Window.partitionBy("k").orderBy("t")))) == exchanges(joined) == 1


def test_factors_and_matrix_have_few_shuffles(spark):
    assert exchanges(entry.queries()["m3_factor_scores"](spark, DATA)) <= 9
    assert exchanges(entry.queries()["m10_feature_matrix"](spark, DATA)) <= 20  # 34 before sides met at once, and 12 of the factors


def test_labels_in_the_rows_themselves(spark):
    rows = spark.createDataFrame([(1, DAY + timedelta(k), 100 + k) for k in range(0, 40, 4)], "asset_id long, d date, c long")
    got = with_label(rows).orderBy("d").collect()
    assert [r.label for r in got] == ["UP"] * 8 + [None] * 2 and got[0].exit_d == DAY + timedelta(8)


def test_a_network_learns_from_labels_in_the_sequences(spark):
    rng = np.random.default_rng(8)
    data = [(1, DAY + timedelta(i), rng.normal(size=(3, 2)).tolist()) for i in range(90)]
    table = spark.createDataFrame(data, "asset_id long, d date, steps array<array<double>>").withColumn("label", F.when(F.col("steps")[2][0] > 0, "UP").otherwise("DOWN"))
    right = sq.score(table, sq.perceptron(table)).join(table, ["asset_id", "d"]).where((F.col("up") > F.col("down")) == (F.col("label") == "UP")).count()
    assert right >= 85


def test_windows_keep_columns_and_training_writes_no_windows(spark, monkeypatch):
    rows = spark.createDataFrame([(1, DAY + timedelta(k), float(k), "UP") for k in range(4)], "asset_id long, d date, x double, label string")
    assert [r.label for r in sq.windows(rows, ["x"], 3, keep=("label",)).collect()] == ["UP", "UP"]
    written = []
    path = models.scratch_path
    monkeypatch.setattr(models, "scratch_path", lambda s, name: written.append(path(s, name)) or written[-1])
    models.sequence_scores(spark, "/root/testdata/sf0.01")
    assert "steps" not in spark.read.parquet(written[0]).columns
