"""A training corpus from documents, in stages; each stage is written and read again by the next.

Defined cases
- null or empty text: scored like any other by the classifier, and dropped by the rules as it has fewer than ten words;
- null ids, repeated ids and repeated rows: rows are told apart by a number; one row of each group of copies stays, and
  the mix may take it up to three times;
- null source or language: a source of its own in the mix; languages are not looked at;
- very long texts are read whole by every stage; extra columns go along up to the last stage, whatever their names;
- no labels: nothing is toxic; an empty table: an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import mixing, near_dedup, quality_rules, sentencepiece_codec, toxicity
from panelforge.llm.common import materialize


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine finds toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails, go."""
    return quality_rules.drop_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group with a similarity of 0.8 or more on five-word shingles."""
    return near_dedup.drop_near_duplicates(docs, shingle=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as the ids of its pieces."""
    return sentencepiece_codec.encode(docs, "doc_id", "lang", "source")


STAGES = [
    ("toxicity", toxic),
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoded),
]

#: A trained classifier and pivotal rounding have no SQL form; the pipeline is tested against brute force on fixtures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs = materialize(docs, f"stage{k}")
        docs = stage(spark, docs, sf_dir)
    return docs
