"""Serving from stored tables: what is missing is worked out and stored; versions of models, of which one is active."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stored(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The table in ``folder``, each write of which is a folder of its own; empty before the first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(f"{folder}/*") if there else spark.createDataFrame([], schema)


def append(rows: DataFrame, folder: str) -> str:
    """Write ``rows`` beside what is there.  Writers have folders of their own, so two at once do not disturb each other."""
    path = f"{folder}/write-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return path


def read_through(requests: DataFrame, folder: str, keys: list[str], schema: T.StructType, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is stored for the requested ``keys``; misses are worked out by ``compute``, stored and returned with the rest.

    ``compute`` gets the missing keys and returns rows of ``schema``; it is not called if nothing is missing.  A request
    with null keys, or one that ``compute`` has nothing for, has no row.  Of rows that two callers stored at once one is
    returned.
    """
    spark = requests.sparkSession
    asked = requests.select(*keys).dropna().distinct()
    have = stored(spark, folder, schema)
    missing = asked.join(have, keys, "left_anti")
    if not missing.isEmpty():
        append(compute(missing).select(*schema.fieldNames()).join(missing, keys, "left_semi").select(*schema.fieldNames()), folder)
        have = stored(spark, folder, schema)
    return have.join(asked, keys, "left_semi").dropDuplicates(keys).select(*schema.fieldNames())


REGISTRATION = T.StructType([T.StructField(n, k) for n, k in (("family", T.StringType()), ("version", T.StringType()), ("registered_at", T.LongType()), ("status", T.StringType()), ("accuracy", T.DoubleType()))])


def registry(registrations: DataFrame) -> DataFrame:
    """family, version, registered_at, status, accuracy, is_active from everything that was ever registered, in any order.

    Of a version its newest registration counts (of equal times the greatest row).  Of each family the newest version that
    is READY is active, ties to the greater version, so there is never more than one, whoever wrote when.
    """
    rest = [f.name for f in REGISTRATION.fields[2:]]
    newest = registrations.where("family is not null and version is not null").groupBy("family", "version").agg(F.max(F.struct(*rest)).alias("r")).select("family", "version", "r.*")
    best = newest.where("status = 'READY'").groupBy("family").agg(F.max(F.struct("registered_at", "version")).alias("b")).select("family", F.col("b.version").alias("active"))
    x = newest.join(best, "family", "left")
    return x.select("family", "version", *rest, F.coalesce(F.col("version") == F.col("active"), F.lit(False)).alias("is_active"))


def importance_snapshot(importances: DataFrame) -> DataFrame:
    """family, version, feature, importance and rank, the greatest first, ties by name."""
    order = Window.partitionBy("family", "version").orderBy(F.desc("importance"), "feature")
    return importances.select("family", "version", "feature", "importance", F.row_number().over(order).alias("rank"))
