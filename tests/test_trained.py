"""Boosting with calibration, weights of families, sequences and ingest."""

from datetime import date, timedelta
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting as bo
from panelforge.operators import sequences as sq
from panelforge.plans import models
from panelforge.sources import panel
from panelforge.streaming import ingest

DAY = date(2024, 1, 1)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    n = 4000
    x = rng.normal(size=(n, 2))
    noisy = x[:, 0] + 0.6 * rng.normal(size=n)
    label = np.where(noisy > 0.6, "UP", np.where(noisy < -0.6, "DOWN", "FLAT"))
    frame = pd.DataFrame({"asset_id": np.arange(n) % 20, "d": [DAY + timedelta(int(i) // 20) for i in range(n)], "a": x[:, 0], "b": x[:, 1], "label": label})
    return spark.createDataFrame(frame).withColumn("d", F.col("d").cast("date"))


def test_boosted_probabilities_are_calibrated_and_survive_saving(spark, labelled, tmp_path):
    cut = DAY + timedelta(140)
    model = bo.fit(labelled.where(F.col("d") < cut), ["a", "b"], rounds=15)
    scored = model.score(labelled.where(F.col("d") >= cut)).cache()
    got = {r["class"]: r for r in bo.report(scored).collect()}
    assert set(got) == set(bo.CLASSES)
    best = scored.where((F.col("a") > 0.6) == (F.col("label") == "UP")).count() / scored.count()
    assert all(r.accuracy >= 0.6 and r.calibration_error <= 0.08 for r in got.values()) and best > 0.6
    assert scored.where(F.abs(F.col("up") + F.col("flat") + F.col("down") - 1) > 2e-4).count() == 0
    model.save(f"file://{tmp_path}/model")
    again = bo.Boosted.load(spark, f"file://{tmp_path}/model").score(labelled.where(F.col("d") >= cut))
    assert again.exceptAll(scored).count() == 0
    with pytest.raises(ValueError, match="too few"):
        bo.fit(labelled.limit(50), ["a", "b"])


def test_nothing_is_kept_beside_the_written_features(spark, monkeypatch):
    """On large tables shuffles, the panel and scaled vectors outgrew the disk beside the features that training reads."""
    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    panel.release()
    others = kept()
    panel.shared_panel(spark, "/root/testdata/sf0.001").count()  # the kept panel's own shuffle goes with its garbage
    before = files()
    rows = models.labelled(spark, "/root/testdata/sf0.001")
    left = {f for f in files() - before if f.endswith(".data")}
    want = models.with_label(models.feature_matrix(spark, "/root/testdata/sf0.001")).select(rows.columns)
    assert not left and kept() - others == set()
    assert rows.columns[:3] == ["asset_id", "d", "label"] and not {"c", "h", "l", "v", "exit_d"} & set(rows.columns) and len(rows.columns) == 44
    assert rows.exceptAll(want).count() == 0 and rows.count() == want.count()
    panel.release()
    levels = []
    fit = bo.GBTClassifier.fit
    monkeypatch.setattr(bo.GBTClassifier, "fit", lambda self, data: levels.append((data.storageLevel.useDisk, self.getCheckpointInterval())) or fit(self, data))
    bo.fit(rows, ["rsi", "ret_3"], rounds=1)
    assert levels == [(False, -1)] * 3


def test_a_class_that_training_lacks(spark, labelled):
    model = bo.fit(labelled.where("label <> 'UP'"), ["a", "b"], rounds=3)
    assert model.score(labelled.limit(200)).where("label_predicted = 'UP'").count() <= 2


def test_weights_follow_accuracy(spark):
    found = lambda *rows: spark.createDataFrame(list(rows), "family string, right long, n long")
    weights = lambda x, **kw: {r.family: r.weight for r in bo.ensemble_weights(x, **kw).collect()}
    assert weights(found(("boosted", 3, 10), ("sequence", 1, 10), ("boosted", 1, 10), ("heuristic", 7, 10))) == {"boosted": 0.2, "sequence": 0.1, "heuristic": 0.7}
    assert weights(found(("boosted", 0, 0))) == {"boosted": 0.0, "sequence": 0.0, "heuristic": 1.0}
    assert weights(found(("heuristic", 0, 9))) == bo.FALLBACK


def test_windows_scaler_and_newest(spark):
    rng = np.random.default_rng(6)
    rows = [(a, DAY + timedelta(i), float(rng.normal(a)), 5.0) for a, n in ((1, 12), (2, 4), (3, 7)) for i in range(n)]
    table = spark.createDataFrame(rows, "asset_id long, d date, x double, y double")
    got = sorted(map(tuple, sq.windows(table, ["x", "y"], 5).collect()))
    of = lambda a: [r for r in rows if r[0] == a]
    want = [(a, of(a)[e][1], [[r[2], r[3]] for r in of(a)[e - 4 : e + 1]]) for a in (1, 3) for e in range(4, len(of(a)))]
    assert got == want
    flat = np.array([v for _, _, w in want for v in w])
    scaler = sq.fit_scaler(sq.windows(table, ["x", "y"], 5))
    assert np.allclose([(r["mean"], r.dev) for r in scaler.orderBy("feature").collect()], [(flat[:, 0].mean(), flat[:, 0].std()), (5.0, 1.0)])
    newest = {r.asset_id: r for r in sq.scaled(sq.newest(table, ["x", "y"], 5, days=9), scaler).collect()}
    assert set(newest) == {1}  # asset 3 has too few rows in the last nine days
    assert np.allclose(newest[1].steps, (np.array(want[7][2]) - [flat[:, 0].mean(), 5.0]) / [flat[:, 0].std(), 1.0])


def test_any_scorer_and_the_stand_in(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(8)
    data = [(1, DAY + timedelta(i), rng.normal(size=(3, 2)).tolist()) for i in range(90)]
    table = spark.createDataFrame(data, "asset_id long, d date, steps array<array<double>>")
    labels = table.select("asset_id", "d", F.when(F.col("steps")[2][0] > 0, "UP").otherwise("DOWN").alias("label"))
    got = sq.score(table, lambda x: np.stack([x[:, 0, 0], x[:, 2, 1], x.sum(axis=(1, 2))], axis=1)).orderBy("d").collect()
    x = np.array([w for _, _, w in data])
    assert np.allclose([(r.down, r.flat, r.up) for r in got], np.stack([x[:, 0, 0], x[:, 2, 1], x.sum(axis=(1, 2))], axis=1))
    right = sq.score(table, sq.perceptron(table, labels)).join(labels, ["asset_id", "d"]).where((F.col("up") > F.col("down")) == (F.col("label") == "UP")).count()
    assert right >= 85
    rows = table.select(array_to_vector(F.flatten("steps")).alias("features"), F.pmod(F.dayofyear("d"), F.lit(3)).cast("double").alias("target"), "asset_id", "d", "steps")
    model = MultilayerPerceptronClassifier(featuresCol="features", labelCol="target", layers=[6, 4, 3], maxIter=5, seed=1).fit(rows)
    own = sq.score(table, sq.network(model.weights.toArray(), [6, 4, 3])).orderBy("d").collect()
    theirs = model.transform(rows).orderBy("d").select(vector_to_array("probability").alias("p")).collect()
    assert np.allclose([(r.down, r.flat, r.up) for r in own], [r.p for r in theirs])


ITEM = "url string, revision long, published date, source string, text string"


def test_replay_in_any_order_gives_one_state(spark, tmp_path):
    names = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "600000")], "asset_id long, alias string")
    batches = [
        [("u1", 1, DAY, "a", "Alpha and be ta"), ("u2", 1, DAY, "a", "600000 up"), (None, 1, DAY, "a", "alpha")],
        [("u1", 2, DAY, "a", "nothing here"), ("u3", 5, DAY, None, "beta"), ("u2", 1, DAY, "a", "600000 up")],
        [("u1", 1, DAY, "a", "Alpha and be ta"), ("u3", 4, DAY, "a", "alpha"), ("u4", 1, None, "a", None)],
    ]
    want = {("u1", 2, ()), ("u2", 1, (3,)), ("u3", 5, (2,)), ("u4", 1, ())}
    for k, order in enumerate(permutations(range(3))):
        folder = f"file://{tmp_path}/{k}"
        for number, at in enumerate([*order, order[0]]):
            found = ingest.versions(spark.createDataFrame(batches[at], ITEM), names)
            ingest.merge(found, folder, number, buckets=2)
            if number == 1:
                ingest.merge(found, folder, number, buckets=2)  # done again after a failure
        final = ingest.state(spark, folder)
        assert {(r.url, r.revision, tuple(r.asset_ids)) for r in final.collect()} == want
        assert sorted(map(tuple, ingest.links(final).collect())) == [("u2", 3), ("u3", 2)]
        if k == 1:
            break  # two orders by batches; all six at once
    versions = [ingest.versions(spark.createDataFrame(b, ITEM), names) for b in batches]
    for order in permutations(versions):
        whole = ingest.latest(order[0].unionByName(order[1]).unionByName(order[2]))
        assert {(r.url, r.revision, tuple(r.asset_ids)) for r in whole.collect()} == want
