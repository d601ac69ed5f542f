"""Sequences for models of time: windows of scaled vectors, the newest one for serving, and batches for a scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps of a sequence, and calendar days in which the newest must lie.
STEPS = 20
RECENT_DAYS = 120


def windows(rows: DataFrame, features: list[str], steps: int = STEPS, keep: tuple[str, ...] = ()) -> DataFrame:
    """asset_id, d, steps and ``keep``: the vectors of the ``steps`` rows that end at each row; rows with fewer behind them are left out."""
    back = Window.partitionBy("asset_id").orderBy("d").rowsBetween(1 - steps, 0)
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    x = rows.select("asset_id", "d", F.collect_list(vector).over(back).alias("steps"), *keep)
    return x.where(F.size("steps") == steps)


def newest(rows: DataFrame, features: list[str], steps: int = STEPS, days: int = RECENT_DAYS) -> DataFrame:
    """The window for serving: of each asset's rows in the ``days`` days before the last day of all the last ``steps``.

    Only these are gathered: rows are cut to the days first, and to the last steps in the aggregate.
    """
    last = rows.agg(F.max("d").alias("last"))  # one row
    recent = rows.crossJoin(F.broadcast(last)).where(F.col("d") > F.date_sub("last", days))
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    ordered = recent.groupBy("asset_id").agg(F.max("d").alias("d"), F.array_sort(F.collect_list(F.struct("d", vector.alias("v")))).alias("x"))
    return ordered.where(F.size("x") >= steps).select("asset_id", "d", F.transform(F.slice("x", -steps, steps), lambda s: s["v"]).alias("steps"))


def fit_scaler(sequences: DataFrame) -> DataFrame:
    """feature (its number), mean and dev (of the population, 1 where it is 0) over all steps of all sequences."""
    each = sequences.select(F.explode("steps").alias("v")).select(F.posexplode("v").alias("feature", "x"))
    out = each.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"))
    return out.withColumn("dev", F.when(F.col("dev") > 0, F.col("dev")).otherwise(F.lit(1.0)))


def scaled(sequences: DataFrame, scaler: DataFrame) -> DataFrame:
    """The sequences with every value less its feature's mean, over its deviation; the scaler is one row a feature."""
    one = scaler.agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "dev"))).alias("_s"))
    x = sequences.crossJoin(F.broadcast(one))
    step = lambda v: F.zip_with(v, F.col("_s"), lambda a, s: (a - s["mean"]) / s["dev"])
    return x.withColumn("steps", F.transform("steps", step)).drop("_s")


Scorer = Callable[[np.ndarray], np.ndarray]


def score(sequences: DataFrame, scorer: Scorer, classes: tuple[str, ...] = ("DOWN", "FLAT", "UP")) -> DataFrame:
    """asset_id, d and a probability for each class (in lower case), from a function of (rows, steps, features) arrays.

    The scorer gets batches as they come; any network that maps such an array to (rows, classes) can stand here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("steps")
                values = np.asarray(lists.flatten().flatten())
                p = scorer(values.reshape(batch.num_rows, len(lists[0]), -1))
                yield pa.RecordBatch.from_arrays([batch.column("asset_id"), batch.column("d"), *[pa.array(p[:, k].astype(np.float64)) for k in range(len(classes))]], names=["asset_id", "d", *[c.lower() for c in classes]])

    kinds = [sequences.schema[c] for c in ("asset_id", "d")]
    return sequences.select("asset_id", "d", "steps").mapInArrow(run, T.StructType([*kinds, *[T.StructField(c.lower(), T.DoubleType()) for c in classes]]))


def perceptron(sequences: DataFrame, labels: DataFrame | None = None, classes: tuple[str, ...] = ("DOWN", "FLAT", "UP"), hidden: int = 16, rounds: int = 60) -> Scorer:
    """A stand-in for a recurrent network: a perceptron over the flattened steps of labelled sequences, as a scorer.

    Labels come by asset_id and d, or, without ``labels``, as a column of the sequences, which then need no shuffle.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    target = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("double") - 1
    rows = sequences if labels is None else sequences.join(labels.select("asset_id", "d", "label"), ["asset_id", "d"])
    rows = rows.where(F.col("label").isin(*classes))
    rows = rows.select(array_to_vector(F.flatten("steps")).alias("features"), target.alias("target"))
    first = rows.first()
    if first is None:
        raise ValueError("no labelled sequence to train on")
    layers = [len(first["features"]), hidden, len(classes)]
    model = MultilayerPerceptronClassifier(featuresCol="features", labelCol="target", layers=layers, maxIter=rounds, blockSize=128, seed=7).fit(rows)
    return network(model.weights.toArray(), layers)


def network(weights: np.ndarray, layers: list[int]) -> Scorer:
    """The function of a perceptron's weights: sigmoids within, shares of the whole at the end."""
    parts, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        parts.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b

    def run(x: np.ndarray) -> np.ndarray:
        x = x.reshape(len(x), -1)
        for k, (w, bias) in enumerate(parts):
            x = x @ w + bias
            if k < len(parts) - 1:
                x = 1 / (1 + np.exp(-x))
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return run
