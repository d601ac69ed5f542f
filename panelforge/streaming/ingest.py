"""Idempotent ingest of news: articles by URL, the last revision wins, and its links replace those of the one before.

An item becomes a version of its article: the columns with the set of assets that its text names.  The state is the
greatest version of each URL, by revision and then by content, which does not depend on the order or the number of times
that items come.  Links are the winner's set, so they are replaced as a whole, and gone where its text names none.

The state is a table in buckets by URL.  A batch writes the buckets that it touches anew, under its own number, and leaves
the others; the state is each bucket's newest writing.  A batch that is done again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.text import link_anywhere

BUCKETS = 32
#: Links of an article, at most, as ``link_anywhere`` ranks them.
MOST_LINKS = 8

VERSION = T.StructType(
    [T.StructField(name, kind) for name, kind in (("url", T.StringType()), ("revision", T.LongType()), ("published", T.DateType()), ("source", T.StringType()), ("text", T.StringType()), ("asset_ids", T.ArrayType(T.LongType())))]
)


def versions(items: DataFrame, aliases: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """The items (url, revision, published, source, text) with the assets that their text names, in order; null urls are left out.

    Of one URL and revision only the greatest by content is a version.
    """
    own = [f.name for f in VERSION.fields[:-1]]
    once = items.where("url is not null").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in VERSION.fields[:-1]])
    once = once.groupBy("url", "revision").agg(F.max(F.struct(*own[2:])).alias("v")).select("url", "revision", "v.*")
    key = F.struct("url", "revision").alias("article_id")
    linked = link_anywhere(once.select(key, "text"), aliases, most).groupBy("article_id").agg(F.array_sort(F.collect_set("asset_id")).alias("asset_ids"))
    linked = linked.select(F.col("article_id.url").alias("url"), F.col("article_id.revision").alias("_revision"), "asset_ids")
    x = once.join(linked, (once["url"] == linked["url"]) & once["revision"].eqNullSafe(linked["_revision"]), "left").drop(linked["url"])
    return x.select(*own, F.coalesce("asset_ids", F.array().cast("array<bigint>")).alias("asset_ids"))


def latest(found: DataFrame) -> DataFrame:
    """The greatest version of each URL."""
    rest = [f.name for f in VERSION.fields[1:]]
    return found.groupBy("url").agg(F.max(F.struct(*rest)).alias("v")).select("url", "v.*")


def links(state: DataFrame) -> DataFrame:
    """url, asset_id: the links as they stand."""
    return state.select("url", F.explode("asset_ids").alias("asset_id"))


def _written(spark: SparkSession, folder: str) -> DataFrame:
    kinds = T.StructType([*VERSION.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(kinds).parquet(folder) if there else spark.createDataFrame([], kinds)


def state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The articles as they stand, with their bucket; ``before``: without that batch and later ones."""
    written = _written(spark, folder)
    if before is not None:
        written = written.where(F.col("batch") < before)
    newest = written.select("batch", "bucket").groupBy("bucket").agg(F.max("batch").alias("batch"))  # a row a bucket
    return written.join(F.broadcast(newest), ["batch", "bucket"]).select(*[f.name for f in VERSION.fields], "bucket")


def merge(found: DataFrame, folder: str, batch: int, buckets: int = BUCKETS) -> None:
    """Write the buckets that the versions ``found`` touch, merged with what they held before the batch."""
    spark = found.sparkSession
    new = found.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int"))
    touched = new.select("bucket").distinct()
    old = state(spark, folder, before=batch).join(F.broadcast(touched), "bucket", "left_semi")
    merged = latest(old.drop("bucket").unionByName(new.drop("bucket"))).withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int"))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={batch}")


def ingest_stream(items: DataFrame, aliases: DataFrame, folder: str, buckets: int = BUCKETS):
    """A writer that merges each batch of the stream ``items`` into the table in ``folder``; the caller sets trigger and checkpoint."""
    return items.writeStream.foreachBatch(lambda batch, number: merge(versions(batch, aliases), folder, number, buckets))
