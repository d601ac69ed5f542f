"""Ingest of news as a batch and as a stream, into one final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import panel
from ..sources.scratch import is_folder, scratch_path
from ..streaming import ingest
from .cte import sql
from .relational import _all_aliases, alias_links

#: Articles that the documents are revisions of.
ARTICLES = 400


def _items(documents):
    published = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") % 2499).cast("int"))
    return documents.select(F.concat(F.lit("news/"), (F.col("doc_id") % ARTICLES).cast("string")).alias("url"), F.col("doc_id").alias("revision"), published.alias("published"), "source", "text")


def _long_aliases(s, d):
    return _all_aliases(s, d).where((F.length("alias") >= 8) | F.col("alias").rlike("^[0-9]+$"))


def _shown(state):
    return state.select("url", "revision", "published", F.size("asset_ids").cast("long").alias("n_links"), F.array_join(F.transform("asset_ids", lambda a: a.cast("string")), ",").alias("links"))


def batch(s, d):
    return _shown(ingest.latest(ingest.versions(_items(panel.table(s, d, "documents")), _long_aliases(s, d))))


def stream(s, d):
    """The documents as a stream of files, merged batch by batch until all are read."""
    path = f"{d}/documents.parquet"
    reader = s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 8)
    if is_folder(s, path):
        documents = reader.parquet(path)
    else:  # a stream reads folders only
        folder, file = path.rsplit("/", 1)
        documents = reader.option("pathGlobFilter", file).parquet(folder)
    to = scratch_path(s, "articles")
    query = ingest.ingest_stream(_items(documents), _long_aliases(s, d), to).option("checkpointLocation", f"{to}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return _shown(ingest.state(s, to))


STATE = f"""with win as (select 'news/' || (doc_id % {ARTICLES}) as url, max(doc_id) as article_id, arg_max(date '1995-01-02' + cast(doc_id % 2499 as integer), doc_id) as published, arg_max(text, doc_id) as text from documents group by 1),
{alias_links("win", "length(alias) >= 8 or digits")}
select url, win.article_id as revision, published, count(asset_id) as n_links, coalesce(string_agg(asset_id::varchar, ',' order by asset_id), '') as links from win left join lk using (article_id) group by 1, 2, 3"""

QUERIES = {"r4_ingest_batch": (batch, sql("assets", STATE)), "r4_ingest_stream": (stream, sql("assets", STATE))}
