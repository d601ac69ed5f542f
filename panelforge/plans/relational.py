"""Queries of scans, filters, aggregations, sorts, sets, text and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import pointintime as pit
from ..operators import text as tx
from ..sources import panel, sinks
from . import lexicon
from .cte import sql
from .windows import RSI, W, r4

FLOOR = "1996-01-01"


def list_of(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def _events(s, d):
    return panel.table(s, d, "events")


def _articles(s, d):
    return panel.news(s, d).select("article_id", "published", "source", "text")


WORDS = r"""
tok as (select article_id, published, source, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}0-9]+'), lambda w: w <> '') as w, text from news)"""
SENT = f"""{WORDS},
cnt as (select article_id, published, source, len(w) as n, len(list_filter(w, lambda x: x in ({list_of(lexicon.POSITIVE)}))) as pos, len(list_filter(w, lambda x: x in ({list_of(lexicon.NEGATIVE)}))) as neg from tok),
sent as (select *, case when n > 0 then greatest(-1.0::double, least(1.0::double, (pos - neg) * 8.0::double / n)) else 0.0::double end as s from cnt)"""

def tags_sql(concepts: dict[str, tuple[str, ...]], name: str = "tg") -> str:
    """CTEs with the concepts of each article whose keywords are in its text, in lower case and without white space."""
    cases = ", ".join(f"case when {' or '.join(f'contains(t, {chr(39)}{tx.bare(k)}{chr(39)})' for k in keys)} then '{concept}' end" for concept, keys in sorted(concepts.items()))
    return f"{name}_t as (select article_id, published, regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g') as t from news), {name} as (select article_id, published, list_filter([{cases}], lambda t: t is not null) as tags from {name}_t)"


TAGS = tags_sql(lexicon.CONCEPTS)


ASSET_WEEK = """lk as (select article_id, unnest(list_distinct([article_id % 50 + 1, article_id % 7 + 1])) as asset_id from news),
ad as (select asset_id, published, sum(cast(floor(s * 1000000 + 0.5) as bigint)) as m, count(*) as n from sent join lk using (article_id) group by 1, 2),
aw as (select asset_id, published, cast(sum(n) over w as bigint) as articles, cast(sum(m) over w as double) / (cast(sum(n) over w as double) * 1000000.0::double) as x
       from ad window w as (partition by asset_id order by published range between interval 6 days preceding and current row))"""


def linked(s, d):
    """Articles with up to two linked assets, one bridge row each."""
    return panel.news(s, d).select("article_id", F.explode(F.array_distinct(F.array(F.col("article_id") % 50 + 1, F.col("article_id") % 7 + 1))).alias("asset_id"))


def asset_week(s, d):
    """asset_id, published, articles, x: mean sentiment of an asset's articles of the last seven days, for each day with some.

    Articles are summed by asset and day first, in 1e-6, so that a window has one row a day.
    """
    x = lexicon.sentiment(_articles(s, d)).select("article_id", "published", F.floor(F.col("sentiment") * 1000000 + 0.5).cast("long").alias("m"))
    day = x.join(linked(s, d), "article_id").groupBy("asset_id", "published").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n"))
    week = Window.partitionBy("asset_id").orderBy(F.datediff("published", F.lit("1970-01-01"))).rangeBetween(-6, 0)
    return day.select("asset_id", "published", F.sum("n").over(week).alias("articles"), (F.sum("m").over(week) / (F.sum("n").over(week) * 1000000.0)).alias("x"))


def _aliases(s, d):
    """Long words of the benchmark items as aliases of assets."""
    names = panel.table(s, d, "benchmark").select("item_id", F.explode(tx.words(F.col("text"))).alias("alias"))
    return names.where(F.length("alias") >= 8).groupBy("alias").agg(F.min(F.col("item_id") % 50 + 1).alias("asset_id"))


def _all_aliases(s, d):
    """Names, symbols and codes of assets, and all words of the benchmark items."""
    known = panel.assets(s, d).select("asset_id", F.col("symbol").alias("name"), F.lpad(F.col("asset_id").cast("string"), 6, "0").alias("symbol"), F.concat(F.lpad(F.col("asset_id").cast("string"), 6, "0"), F.lit(".SZ")).alias("code"))
    names = panel.table(s, d, "benchmark").select((F.col("item_id") % 50 + 1).alias("asset_id"), F.explode(tx.words(F.col("text"))).alias("alias"))
    return names.groupBy("alias").agg(F.min("asset_id").alias("asset_id")).select("asset_id", "alias").unionByName(tx.aliases_of(known))


def alias_links(texts: str = "news", which: str = "true") -> str:
    """CTEs up to lk (article_id, asset_id, alias, rank): the aliases for which ``which`` holds in the texts of a CTE."""
    return rf"""al as (
  select min(item_id % 50 + 1) as asset_id, a as alias from (select item_id, unnest(string_split_regex(lower(text), '[^\p{{L}}0-9]+')) as a from benchmark) where a <> '' group by a
  union select asset_id, unnest([symbol, lpad(asset_id::varchar, 6, '0'), lpad(asset_id::varchar, 6, '0') || '.sz']) from assets),
pc as (select *, case when digits then alias else regexp_replace(lower(alias), '\s+', '', 'g') end as piece from (select *, regexp_full_match(alias, '[0-9]+') as digits from al) where {which}),
tx as (select article_id, regexp_replace(lower(text), '\s+', '', 'g') as t, text from {texts} where text is not null),
hit as (select article_id, asset_id, alias, length(piece) as n from tx join pc on case when digits then regexp_matches(text, '(^|[^0-9])' || piece || '($|[^0-9])') else contains(t, piece) end),
one as (select article_id, asset_id, max(n) as n, arg_max(alias, (n, alias)) as alias from hit group by 1, 2),
lk as (select article_id, asset_id, alias, rank from (select *, row_number() over (partition by article_id order by n desc, asset_id) as rank from one) where rank <= 8)"""


QUERIES = {
    # scans and sources
    "s1_windowed_scan": (
        lambda s, d: panel.bars(s, d).where("d >= date_sub(date'1998-06-30', 200) and d <= date'1998-06-30'").select("asset_id", "d", "c", "v"),
        sql("bars", "select asset_id, d, c, v from bars where d >= date '1998-06-30' - 200 and d <= date '1998-06-30'"),
    ),
    "s2_last_rows": (
        lambda s, d: panel.bars(s, d).where("d <= date'1999-06-30'").withColumn("r", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("d")))).where("r <= 30").select("asset_id", "d", "c", "v", "r"),
        sql("bars", "select asset_id, d, c, v, r from (select *, row_number() over (partition by asset_id order by d desc) as r from bars where d <= date '1999-06-30') where r <= 30"),
    ),
    "s4_calendar": (lambda s, d: panel.calendar(panel.bars(s, d)).where("d between '1996-01-01' and '1997-12-31'"), sql("calendar", "select d from calendar where d between '1996-01-01' and '1997-12-31'")),
    "s6_incremental_bars": (
        lambda s, d: _incremental(s, d),
        sql("bars", "with old as (select asset_id, max(d) as last from bars where d < date '1999-01-01' and v >= 20 group by 1) select b.asset_id, b.d, b.c, b.v * 100 as volume from bars b left join old using (asset_id) where b.d > coalesce(old.last, date '1996-01-01' - 1)"),
    ),
    "s7_current_constituents": (
        lambda s, d: _constituents(s, d),
        sql("membership", "select asset_id, array_to_string(list_sort(list(distinct m.index_code)), ',') as tags from membership m join (select index_code, max(trade_date) as t from membership group by 1) x on m.index_code = x.index_code and m.trade_date = x.t group by asset_id"),
    ),
    "s9_first_status_wins": (
        lambda s, d: sinks.first_of([panel.table(s, d, "customer").where(cond).select("c_nationkey", F.lit(name).alias("status"), F.col("c_custkey").alias("n")) for name, cond in (("L", "c_acctbal > 9000"), ("D", "c_acctbal < -500"), ("P", "c_acctbal between 0 and 4000"))], "c_nationkey"),
        "select c_nationkey, status, n from (select *, row_number() over (partition by c_nationkey order by k, status, n) as r from (select c_nationkey, 'L' as status, c_custkey as n, 0 as k from customer where c_acctbal > 9000 union all select c_nationkey, 'D', c_custkey, 1 from customer where c_acctbal < -500 union all select c_nationkey, 'P', c_custkey, 2 from customer where c_acctbal between 0 and 4000)) where r = 1",
    ),
    "s11_report_dedupe": (
        lambda s, d: _reports(s, d),
        sql("fundamentals", "with h as (select asset_id, cast(date_trunc('quarter', report_date) as date) as quarter, available_date, roe_bp, row_number() over (partition by asset_id, date_trunc('quarter', report_date) order by available_date desc, roe_bp) as r from fundamentals) select asset_id, quarter, roe_bp, roe_bp - lag(roe_bp) over (partition by asset_id order by quarter) as roe_qoq_bp from h where r = 1"),
    ),
    "s16_fieldwise_fallback": (
        lambda s, d: _fallback(s, d),
        sql("macro", "with p as (select date, pmi, cpi10 from macro where month(date) <> 5), f as (select date, 50 as pmi, cpi10 + 1 as cpi10 from macro) select coalesce(p.date, f.date) as date, coalesce(p.pmi, f.pmi) as pmi, coalesce(p.cpi10, f.cpi10) as cpi10, case when p.pmi is null then 'fallback' else 'primary' end as pmi_from, case when p.cpi10 is null then 'fallback' else 'primary' end as cpi_from from p full join f on p.date = f.date"),
    ),
    "s18_news_urls": (
        lambda s, d: panel.news(s, d).select("article_id", F.sha2(F.concat_ws("|", "source", F.col("published").cast("string"), F.coalesce("text", F.lit(""))), 256).alias("url_hash")),
        sql("news", "select article_id, sha256(concat_ws('|', source, cast(published as varchar), coalesce(text, ''))) as url_hash from news"),
    ),
    "s19_news_dedupe": (
        lambda s, d: panel.news(s, d).where("published between '1995-06-01' and '1999-06-30'").groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct(F.col("source").isNull(), "source", "article_id", "published")).alias("r")).select("r.article_id", "r.published", "r.source"),
        sql("news", "select article_id, published, source from (select *, row_number() over (partition by text order by source nulls last, article_id) as r from news where published between '1995-06-01' and '1999-06-30') where r = 1"),
    ),
    "s20_request_windows": (
        lambda s, d: _spans(panel.calendar(panel.bars(s, d)), 60),
        sql("calendar", "select cast(a as date) as start_d, least(cast(a + interval 60 month as date) - 1, hi) as end_d from (select min(d) as lo, max(d) as hi from calendar), unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 60 month)) as t(a)"),
    ),
    "s21_month_windows": (
        lambda s, d: _spans(panel.calendar(panel.bars(s, d)), 36),
        sql("calendar", "select cast(a as date) as start_d, least(cast(a + interval 36 month as date) - 1, hi) as end_d from (select min(d) as lo, max(d) as hi from calendar), unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 36 month)) as t(a)"),
    ),
    "s22_backfill_window": (
        lambda s, d: panel.news(s, d).agg(F.min("published").alias("m")).select(F.greatest(F.lit("1994-12-01").cast("date"), F.date_sub("m", 30)).alias("start_d"), F.date_sub("m", 1).alias("end_d")),
        sql("news", "select greatest(date '1994-12-01', min(published) - 30) as start_d, min(published) - 1 as end_d from news"),
    ),
    "s23_earliest_by_series": (
        lambda s, d: panel.macro(s, d).agg(F.min(F.when(F.col("pmi").isNotNull(), F.col("date"))).alias("pmi_from"), F.max(F.when(F.col("pmi").isNotNull(), F.col("date"))).alias("pmi_to"), F.min("date").alias("any_from"), F.max("date").alias("any_to")),
        sql("macro", "select min(date) filter (where pmi is not null) as pmi_from, max(date) filter (where pmi is not null) as pmi_to, min(date) as any_from, max(date) as any_to from macro"),
    ),
    "s24_latest_bar": (
        lambda s, d: pit.latest(panel.bars(s, d).where("d <= date'2000-01-31'"), "asset_id", "d"),
        sql("bars", "select asset_id, max(d) as d, arg_max(c, d) as c, arg_max(h, d) as h, arg_max(l, d) as l, arg_max(v, d) as v from bars where d <= date '2000-01-31' group by asset_id"),
    ),
    "s25_floor": (lambda s, d: panel.bars(s, d).where(F.col("d") >= F.greatest(F.lit("1990-01-01"), F.lit(FLOOR)).cast("date")).groupBy("asset_id").agg(F.min("d").alias("first_d")), sql("bars", f"select asset_id, min(d) as first_d from bars where d >= date '{FLOOR}' group by asset_id")),
    # sinks
    "k1_upsert": (
        lambda s, d: sinks.upserted(panel.bars(s, d).where("d < '1998-01-01'").select("asset_id", "d", "c"), panel.bars(s, d).where("d between '1997-06-01' and '1998-06-30'").select("asset_id", "d", (F.col("c") + 1).alias("c")), "asset_id", "d"),
        sql("bars", "select asset_id, d, case when d >= '1997-06-01' then c + 1 else c end as c from bars where d <= '1998-06-30'"),
    ),
    "k2_insert_ignore": (
        lambda s, d: sinks.inserted(panel.bars(s, d).where("d < '1998-01-01'").select("asset_id", "d", "c"), panel.bars(s, d).where("d between '1997-06-01' and '1998-06-30'").select("asset_id", "d", (F.col("c") + 1).alias("c")), "asset_id", "d"),
        sql("bars", "select asset_id, d, case when d >= '1998-01-01' then c + 1 else c end as c from bars where d <= '1998-06-30'"),
    ),
    "k7_purge_counts": (
        lambda s, d: sinks.purge_counts({"bars": (panel.bars(s, d), "d"), "flows": (panel.flows(s, d), "d"), "macro": (panel.macro(s, d), "date"), "news": (panel.news(s, d), "published")}, FLOOR),
        sql("bars flows macro news", " union all ".join(f"select '{t}' as table_name, count(*) filter (where {c} < date '{FLOOR}') as deleted, count(*) filter (where {c} >= date '{FLOOR}') as kept from {t}" for t, c in (("bars", "d"), ("flows", "d"), ("macro", "date"), ("news", "published")))),
    ),
    # filters
    "p1_asset_search": (
        lambda s, d: asset_search(panel.assets(s, d), market="ASIA", status="active", text="00001").select("asset_id", "symbol", "country", "market"),
        sql("assets", "select asset_id, symbol, country, market from assets where market = 'ASIA' and active and (contains(lower(symbol), '00001') or contains(lower(country), '00001'))"),
    ),
    "p2_bar_range": (lambda s, d: panel.bars(s, d).where("d between '1997-01-01' and '1998-12-31'"), sql("bars", "select asset_id, d, c, h, l, v from bars where d between '1997-01-01' and '1998-12-31'")),
    "p4_recent_events": (
        lambda s, d: _events(s, d).where((F.col("ts") >= F.expr("timestamp_ntz'2024-01-23 00:00:00'")) & F.col("event_type").contains("c")).select("event_id", "user_id", "event_type"),
        "select event_id, user_id, event_type from events where ts >= timestamp '2024-01-23 00:00:00' and contains(event_type, 'c')",
    ),
    "p8_universe": (
        lambda s, d: _universe(s, d),
        sql("assets", "with t as (select *, len(tags) > 0 as tagged from assets where active) select asset_id, symbol from t where tagged or not (select bool_or(tagged) from t)"),
    ),
    "p10_json_path": (
        lambda s, d: _events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k >= 5"),
        "select event_id, k from (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events) where k >= 5",
    ),
    "p12_reprocess": (
        lambda s, d: panel.fundamentals(s, d).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("pe").isNull() | F.col("pb").isNull()).alias("redo")),
        sql("fundamentals", "select asset_id, count(*) as n, bool_or(pe is null or pb is null) as redo from fundamentals group by asset_id"),
    ),
    "p14_weekdays": (lambda s, d: panel.calendar(panel.bars(s, d)).where(F.weekday("d").isin(0, 2, 4)), sql("calendar", "select d from calendar where isodow(d) in (1, 3, 5)")),
    # aggregations
    "a1_count_by_type": (lambda s, d: _events(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "select event_type, count(*) as n from events group by event_type"),
    "a2_sentiment_7d": (
        lambda s, d: asset_week(s, d).select("asset_id", "published", "articles", F.floor(F.col("x") * 10000 + 0.5).alias("mean_e4")),
        sql("news", f"with {SENT.strip()}, {ASSET_WEEK} select asset_id, published, articles, cast(floor(x * 10000 + 0.5) as bigint) as mean_e4 from aw"),
    ),
    "a4_extremes": (lambda s, d: panel.bars(s, d).agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count_distinct("asset_id").alias("assets"), F.count_distinct("d").alias("days")), sql("bars", "select min(d) as first_d, max(d) as last_d, count(distinct asset_id) as assets, count(distinct d) as days from bars")),
    "a5_conditional_counts": (
        lambda s, d: panel.fundamentals(s, d).agg(F.count(F.lit(1)).alias("total"), F.count("pe").alias("known"), F.count_if(F.col("pe").isNull()).alias("missing"), F.count_if(F.col("roe_bp") == 0).alias("zero"), F.count_if(F.col("pe") == 50).alias("half")),
        sql("fundamentals", "select count(*) as total, count(pe) as known, count(*) filter (where pe is null) as missing, count(*) filter (where roe_bp = 0) as zero, count(*) filter (where pe = 50) as half from fundamentals"),
    ),
    "a6_by_source": (
        lambda s, d: panel.news(s, d).groupBy(F.coalesce("source", F.lit("<missing>")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("published").alias("first_d"), F.max("published").alias("last_d")),
        sql("news", "select coalesce(source, '<missing>') as source, count(*) as n, min(published) as first_d, max(published) as last_d from news group by 1"),
    ),
    "a7_grouping_sets": (
        lambda s, d: panel.table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level")),
        "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping_id(o_orderstatus, o_orderpriority) as bigint) as level from orders group by cube (o_orderstatus, o_orderpriority)",
    ),
    "a8_concept_heat": (
        lambda s, d: lexicon.tags(panel.news(s, d)).select("published", F.explode("tags").alias("tag")).groupBy("published", "tag").agg(F.count(F.lit(1)).alias("heat")),
        sql("news", f"with {TAGS} select published, tag, count(*) as heat from (select published, unnest(tags) as tag from tg) group by 1, 2"),
    ),
    "a15_monthly_report": (
        lambda s, d: panel.bars(s, d).groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.count_distinct("d").alias("days"), F.count_distinct("asset_id").alias("assets"), F.sum("v").alias("volume")),
        sql("bars", "select strftime(d, '%Y-%m') as month, count(distinct d) as days, count(distinct asset_id) as assets, cast(sum(v) as bigint) as volume from bars group by 1"),
    ),
    "a16_usage": (
        lambda s, d: _events(s, d).groupBy("user_id").agg(F.count_if(F.to_date("ts") == F.lit("2024-01-30").cast("date")).alias("today"), F.count(F.lit(1)).alias("month"), F.count_distinct("event_type").alias("endpoints")).withColumn("percent", F.floor(F.col("month") * 100.0 / 150)),
        "select user_id, count(*) filter (where cast(ts as date) = date '2024-01-30') as today, count(*) as month, count(distinct event_type) as endpoints, cast(floor(count(*) * 100.0::double / 150) as bigint) as percent from events group by 1",
    ),
    "a16_top_endpoints": (
        lambda s, d: _endpoints(s, d),
        "select user_id, event_type, n, place from (select *, row_number() over (partition by user_id order by n desc, event_type) as place from (select user_id, event_type, count(*) as n from events where cast(ts as date) > date '2024-01-30' - 7 group by 1, 2)) where place <= 10",
    ),
    "a18_importance_totals": (
        lambda s, d: _importance_history(s, d),
        "with one as (select p_partkey % 3 as horizon, p_brand as feature, p_partkey % 15 as model, cast(sum(cast(p_size as bigint)) as bigint) as importance from part group by 1, 2, 3), by_f as (select horizon, feature, cast(sum(importance) as bigint) as total, string_agg(model || ':' || importance, ',' order by model) as history from one group by 1, 2) select horizon, place, feature, total, history from (select *, row_number() over (partition by horizon order by total desc, feature) as place from by_f) where place <= 5",
    ),
    "a20_high_low": (
        lambda s, d: panel.bars(s, d).select("asset_id", "d", F.max("h").over(Window.partitionBy("asset_id").orderBy("d").rowsBetween(-19, 0)).alias("high20"), F.min("l").over(Window.partitionBy("asset_id").orderBy("d").rowsBetween(-19, 0)).alias("low20")),
        sql("bars", f"select asset_id, d, max(h) over w as high20, min(l) over w as low20 from bars window w as ({W} rows between 19 preceding and current row)"),
    ),
    # sorts and sets
    "t1_rsi_extremes": (
        lambda s, d: _extreme_rsi(s, d),
        sql("bars", f"with {RSI.strip()}, x as (select asset_id, d, {r4('rsi')} as rsi from rsi) select * from (select *, 'overbought' as side from x order by rsi desc, asset_id, d limit 20) union all select * from (select *, 'oversold' as side from x order by rsi, asset_id, d limit 20)"),
    ),
    "t5_nulls_order": (
        lambda s, d: panel.fundamentals(s, d).orderBy(F.col("pe").desc_nulls_first(), "asset_id", "report_date").limit(100).select("asset_id", "report_date", "pe"),
        sql("fundamentals", "select asset_id, report_date, pe from fundamentals order by pe desc nulls first, asset_id, report_date limit 100"),
    ),
    "t7_page": (
        lambda s, d: panel.assets(s, d).orderBy("symbol").offset(5).limit(4).select("asset_id", "symbol"),
        sql("assets", "select asset_id, symbol from assets order by symbol limit 4 offset 5"),
    ),
    "t8_order_preserving_dedupe": (
        lambda s, d: panel.news(s, d).select("article_id", F.array_join(F.array_distinct(tx.words(F.col("text"))), " ").alias("distinct_words")),
        sql("news", f"with {WORDS.strip()}, wx as (select article_id, unnest(w) as x, generate_subscripts(w, 1) as i from tok), one as (select article_id, x, min(i) as i from wx group by 1, 2) select article_id, coalesce(words, '') as distinct_words from tok left join (select article_id, string_agg(x, ' ' order by i) as words from one group by 1) using (article_id)"),
    ),
    "u1_index_union": (
        lambda s, d: _index(s, d, "IDX_A").union(_index(s, d, "IDX_B")).distinct(),
        sql("membership", "select asset_id from membership where index_code = 'IDX_A' union select asset_id from membership where index_code = 'IDX_B'"),
    ),
    "u2_tag_algebra": (
        lambda s, d: _tags(s, d),
        sql("assets", "select asset_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(['OLD', case when asset_id % 2 = 0 then 'IDX_A' else 'IDX_B' end], lambda t: not list_contains(['IDX_A', 'IDX_B'], t)), tags))), ',') as tags, len(list_intersect(['OLD', case when asset_id % 2 = 0 then 'IDX_A' else 'IDX_B' end], tags)) as same from assets"),
    ),
    "u4_observed_days": (
        lambda s, d: panel.bars(s, d).where("v >= 60").select("d").intersect(panel.bars(s, d).where("c < 18000").select("d")),
        sql("bars", "select d from bars where v >= 60 intersect select d from bars where c < 18000"),
    ),
    "u5_concat": (
        lambda s, d: panel.bars(s, d).where("v >= 60").select("asset_id", "d", "c").unionByName(panel.bars(s, d).where("v < 10").select("c", "d", "asset_id")),
        sql("bars", "select asset_id, d, c from bars where v >= 60 or v < 10"),
    ),
    "u6_overlap_count": (lambda s, d: panel.assets(s, d).agg(F.count_if(F.size("tags") > 1).alias("overlap"), F.count(F.lit(1)).alias("n")), sql("assets", "select count(*) filter (where len(tags) > 1) as overlap, count(*) as n from assets")),
    # text
    "m20_lexicon_sentiment": (
        lambda s, d: lexicon.sentiment(_articles(s, d)).select("article_id", "n", "pos", "neg", *[F.floor(F.col(c) * 10000 + 0.5).alias(c) for c in ("sentiment", "positive", "neutral", "negative")], "label"),
        sql("news", f"with {SENT.strip()} select article_id, n, pos, neg, cast(floor(s * 10000 + 0.5) as bigint) as sentiment, cast(floor((case when n > 0 then greatest(0.0::double, s) else {1 / 3!r}::double end) * 10000 + 0.5) as bigint) as positive, cast(floor((case when n > 0 then 1 - abs(s) else {1 / 3!r}::double end) * 10000 + 0.5) as bigint) as neutral, cast(floor((case when n > 0 then greatest(0.0::double, -s) else {1 / 3!r}::double end) * 10000 + 0.5) as bigint) as negative, case when s >= 0.15 then 'POSITIVE' when s <= -0.15 then 'NEGATIVE' else 'NEUTRAL' end as label from sent"),
    ),
    "m22_concept_tags": (
        lambda s, d: lexicon.tags(panel.news(s, d)).select("article_id", F.array_join("tags", ",").alias("tags")),
        sql("news", f"with {TAGS} select article_id, array_to_string(tags, ',') as tags from tg"),
    ),
    "m22_default_concepts": (
        lambda s, d: tx.tags(panel.news(s, d)).select("article_id", F.array_join("tags", ",").alias("tags")),
        sql("news", f"with {tags_sql(tx.CONCEPTS)} select article_id, array_to_string(tags, ',') as tags from tg"),
    ),
    "j17_text_links": (
        lambda s, d: tx.link(panel.news(s, d), _aliases(s, d)),
        sql("news", rf"with {WORDS.strip()}, al as (select a as alias, min(item_id % 50 + 1) as asset_id from (select item_id, unnest(string_split_regex(lower(text), '[^\p{{L}}0-9]+')) as a from benchmark) where length(a) >= 8 group by 1), hit as (select distinct article_id, alias, asset_id from (select article_id, unnest(list_distinct(w)) as alias from tok) join al using (alias)), one as (select article_id, asset_id, max(length(alias)) as n, arg_max(alias, (length(alias), alias)) as alias from hit group by 1, 2) select article_id, asset_id, alias, rank from (select *, row_number() over (partition by article_id order by n desc, asset_id) as rank from one) where rank <= 8"),
    ),
    "j17_alias_links": (lambda s, d: tx.link_anywhere(panel.news(s, d), _all_aliases(s, d)), sql("news assets", f"with {alias_links()} select * from lk")),
    "m23_neutral_fill": (
        lambda s, d: _filled(s, d),
        sql("news assets", f"with {SENT.strip()}, sc as (select article_id % 50 + 1 as asset_id, sum(cast(floor(s * 1000000 + 0.5) as bigint)) as m, count(*) as n from sent group by 1) select asset_id, coalesce(cast(floor(cast(m as double) / (n * 100.0::double) + 0.5) as bigint), 0) as mean_e4, coalesce(n, 0) as n from assets left join sc using (asset_id) where active"),
    ),
}


def asset_search(assets, market: str | None = None, status: str | None = None, text: str = ""):
    """Assets by exact market and status and by a part of symbol or name (here the country), without case; by symbol."""
    if market is not None:
        assets = assets.where(F.col("market") == market)
    if status is not None:
        assets = assets.where(F.col("active") == (status == "active"))
    low = text.strip().lower()
    if low:
        assets = assets.where(F.lower("symbol").contains(low) | F.lower("country").contains(low))
    return assets.orderBy("symbol", "country")


def _endpoints(s, d):
    """The ten most used endpoints of the last seven days, of every user; a user's endpoints are counted first."""
    week = _events(s, d).where(F.to_date("ts") > F.date_sub(F.lit("2024-01-30").cast("date"), 7)).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))
    return week.withColumn("place", rank).where("place <= 10")


def _importance_history(s, d):
    """Sum of each feature's importance over the models of a horizon, its place, and its history by model, for the top five."""
    x = panel.table(s, d, "part").select((F.col("p_partkey") % 3).alias("horizon"), (F.col("p_partkey") % 15).alias("model"), F.col("p_brand").alias("feature"), F.col("p_size").cast("long").alias("n"))
    one = x.groupBy("horizon", "feature", "model").agg(F.sum("n").alias("importance"))
    by = one.groupBy("horizon", "feature").agg(F.sum("importance").alias("total"), F.array_sort(F.collect_list(F.struct("model", "importance"))).alias("h"))
    rank = F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc("total"), "feature"))
    history = F.array_join(F.transform("h", lambda r: F.concat_ws(":", r["model"].cast("string"), r["importance"].cast("string"))), ",")
    return by.withColumn("place", rank).where("place <= 5").select("horizon", "place", "feature", "total", history.alias("history"))


def _extreme_rsi(s, d):
    """The 20 highest and the 20 lowest RSI rows."""
    x = ind.rsi_columns(panel.bars(s, d)).select("asset_id", "d", ind.four(F.col("rsi")).alias("rsi"))
    top = x.orderBy(F.desc("rsi"), "asset_id", "d").limit(20).withColumn("side", F.lit("overbought"))
    return top.unionByName(x.orderBy("rsi", "asset_id", "d").limit(20).withColumn("side", F.lit("oversold")))


def _incremental(s, d):
    bars = panel.bars(s, d)
    old = bars.where("d < date'1999-01-01' and v >= 20").groupBy("asset_id").agg(F.max("d").alias("last"))
    fresh = bars.join(old, "asset_id", "left").where(F.col("d") > F.coalesce("last", F.date_sub(F.lit(FLOOR).cast("date"), 1)))
    return fresh.select("asset_id", "d", "c", (F.col("v") * 100).alias("volume"))


def _constituents(s, d):
    m = panel.membership(panel.calendar(panel.bars(s, d)), panel.assets(s, d))
    newest = m.groupBy("index_code").agg(F.max("trade_date").alias("trade_date"))
    current = m.join(newest, ["index_code", "trade_date"])
    return current.groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("index_code")), ",").alias("tags"))


def _reports(s, d):
    f = panel.fundamentals(s, d).withColumn("quarter", F.trunc("report_date", "quarter"))
    rank = F.row_number().over(Window.partitionBy("asset_id", "quarter").orderBy(F.desc("available_date"), "roe_bp"))
    one = f.withColumn("r", rank).where("r = 1")
    back = F.lag("roe_bp").over(Window.partitionBy("asset_id").orderBy("quarter"))
    return one.select("asset_id", "quarter", "roe_bp", (F.col("roe_bp") - back).alias("roe_qoq_bp"))


def _fallback(s, d):
    m = panel.macro(s, d)
    p = m.where(F.month("date") != 5).select("date", F.col("pmi").alias("p1"), F.col("cpi10").alias("c1"))
    f = m.select("date", F.lit(50).cast("long").alias("p2"), (F.col("cpi10") + 1).alias("c2"))
    both = p.join(f, "date", "full")
    by = lambda c: F.when(F.col(c).isNull(), "fallback").otherwise("primary")
    return both.select("date", F.coalesce("p1", "p2").alias("pmi"), F.coalesce("c1", "c2").alias("cpi10"), by("p1").alias("pmi_from"), by("c1").alias("cpi_from"))


def _spans(days, months: int):
    edge = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    starts = edge.select("hi", F.explode(F.sequence("lo", "hi", F.make_interval(months=F.lit(months)))).alias("start_d"))
    return starts.select("start_d", F.least(F.date_sub(F.add_months("start_d", months), 1), "hi").alias("end_d"))


def _universe(s, d):
    a = panel.assets(s, d).where("active").withColumn("tagged", F.size("tags") > 0)
    some = a.agg(F.bool_or("tagged").alias("some"))
    return a.crossJoin(F.broadcast(some)).where("tagged or not some").select("asset_id", "symbol")


def _index(s, d, code):
    return panel.membership(panel.calendar(panel.bars(s, d)), panel.assets(s, d)).where(F.col("index_code") == code).select("asset_id")


def _tags(s, d):
    old = F.array(F.lit("OLD"), F.when(F.col("asset_id") % 2 == 0, "IDX_A").otherwise("IDX_B"))
    managed = F.array(F.lit("IDX_A"), F.lit("IDX_B"))
    new = F.array_sort(F.array_union(F.array_except(old, managed), "tags"))
    return panel.assets(s, d).select("asset_id", F.array_join(new, ",").alias("tags"), F.size(F.array_intersect(old, "tags")).cast("long").alias("same"))


def _filled(s, d):
    x = lexicon.sentiment(_articles(s, d)).select((F.col("article_id") % 50 + 1).alias("asset_id"), F.floor(F.col("sentiment") * 1000000 + 0.5).cast("long").alias("m"))
    got = x.groupBy("asset_id").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n"))
    all_ = panel.assets(s, d).where("active").select("asset_id").join(got, "asset_id", "left")
    return all_.select("asset_id", F.coalesce(F.floor(F.col("m") / (F.col("n") * 100.0) + 0.5), F.lit(0)).alias("mean_e4"), F.coalesce("n", F.lit(0)).alias("n"))
