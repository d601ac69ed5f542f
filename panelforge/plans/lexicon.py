"""The lexicon that the queries use: frequent tokens of the tables' invented prose, which holds no word of a real one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import text as tx

POSITIVE = ("thatin", "hehely", "thing", "inter", "ander")
NEGATIVE = ("ononst", "inoran", "erble", "anies", "reth")
CONCEPTS = {"thes": ("thes", "these"), "onan": ("onan",), "erin": ("erin", "inger"), "leque": ("leque", "aux"), "mente": ("mente",), "keit": ("keit", "heit")}


def sentiment(articles: DataFrame) -> DataFrame:
    return tx.sentiment(articles, POSITIVE, NEGATIVE)


def tags(articles: DataFrame) -> DataFrame:
    return tx.tags(articles, CONCEPTS)
