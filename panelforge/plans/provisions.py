"""Queries of provider readers, resumption, notifications and serving."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.parameters import Backtest, Screen
from ..operators import features as ft
from ..operators import indicators as ind
from ..operators import pointintime as pit
from ..operators import scoring as sc
from ..sources import panel, sinks
from ..sources import providers as pv
from ..sources.scratch import scratch_path
from ..streaming import alerts
from .composites import ALERTS, MATRIX_ROWS, feature_matrix
from .cte import sql
from .joins import MEMBERS
from .relational import ASSET_WEEK, SENT, asset_week
from .scores import HEURISTIC, predictions
from .windows import RSI, r4

#: Two provider forms of the month's macro values, and three of the news.
MACRO = {
    "primary": pv.Mapping({"date": "to_date(month, 'yyyyMM')", "pmi": "try_cast(pmi010000 as bigint)", "cpi10": "cast(round(nt_yoy * 10) as bigint)"}, ("date",)),
    "fallback": pv.Mapping({"date": "trunc(day, 'MM')", "pmi": "index_value", "cpi10": "cast(null as bigint)"}, ("date",)),
}
NEWS = {
    "flash": pv.Mapping({"url": "url", "title": "substring(content, 1, 40)", "body": "content", "published": "to_date(datetime)", "source": "src"}, ("published",)),
    "major": pv.Mapping({"url": "cast(null as string)", "title": "title", "body": "title", "published": "pub", "source": "'major'"}, ("published",)),
    "wire": pv.Mapping({"url": "link", "title": "head", "body": "coalesce(summary, head)", "published": "day", "source": "coalesce(site, 'wire')"}, ("published",)),
}


def _macro_raw(s, d):
    m = panel.macro(s, d)
    first = m.where(F.month("date") != 5).select(F.date_format("date", "yyyyMM").alias("month"), F.coalesce(F.col("pmi").cast("string"), F.lit("-")).alias("pmi010000"), (F.col("cpi10") / 10.0).alias("nt_yoy"))
    second = m.select(F.date_add("date", 9).alias("day"), (F.coalesce("pmi", F.lit(50)) + 1).alias("index_value"))
    return first, second


def _macro_filled(s, d):
    first, second = _macro_raw(s, d)
    return pv.filled(pv.mapped(first, MACRO["primary"]), pv.mapped(second, MACRO["fallback"]), "date")


def _news_raw(s, d):
    n = panel.news(s, d)
    kind = F.col("article_id") % 3
    text = F.coalesce("text", F.lit(""))
    return {
        "flash": n.where(kind == 0).select("url", text.alias("content"), F.date_format("published", "yyyy-MM-dd 08:00:00").alias("datetime"), F.col("source").alias("src")),
        "major": n.where(kind == 1).select(F.substring(text, 1, 60).alias("title"), F.when(F.col("article_id") % 5 != 0, F.col("published")).alias("pub")),
        "wire": n.where(kind == 2).select(F.when(F.col("article_id") % 4 != 0, F.col("url")).alias("link"), F.substring(text, 1, 30).alias("head"), F.when(F.length(text) > 200, F.substring(text, 31, 100)).alias("summary"), F.col("published").alias("day"), F.col("source").alias("site")),
    }


def _news(s, d):
    one = pv.dispatch(_news_raw(s, d), NEWS)
    one = one.withColumn("url", pv.url_of(F.col("url"), F.col("source"), F.col("title"), F.col("published")))
    return one.select("provider", "url", "published", "source", F.length("title").alias("title_chars"), F.sha2("body", 256).alias("body_hash"))


NEWS_SQL = """raw as (select article_id, url, published, source, coalesce(text, '') as t, article_id % 3 as kind from news),
nn as (select 'flash' as provider, url, substring(t, 1, 40) as title, t as body, published, source from raw where kind = 0
  union all select 'major', null, substring(t, 1, 60), substring(t, 1, 60), published, 'major' from raw where kind = 1 and article_id % 5 <> 0
  union all select 'wire', case when article_id % 4 <> 0 then url end, substring(t, 1, 30), case when length(t) > 200 then substring(t, 31, 100) else substring(t, 1, 30) end, published, coalesce(source, 'wire') from raw where kind = 2)
select provider, coalesce(url, 'news://' || sha256(concat(coalesce(source, ''), '|', title, '|', cast(published as varchar)))) as url, published, source, length(title) as title_chars, sha256(body) as body_hash from nn"""


def _impacts(s, d):
    """Stored impact rows: event tag, months after it, mean change; tags are bars' months by their remainder."""
    m = panel.macro(s, d)
    tag = F.element_at(F.array(F.lit("rate_cut_cycle"), F.lit("trade_war"), F.lit("stimulus")), (F.month("date") % 3 + 1).cast("int"))
    return m.select(tag.alias("event_tag"), F.col("date").alias("month"), (F.col("y10") - F.col("y2")).alias("impact_bp"))


def _notices(s, d):
    """Fired alerts by channel and status; an event without a channel's address fails there."""
    fired = alerts.fired(panel.table(s, d, "events"), 95.0)
    each = fired.select("event_type", "event_id", F.explode(F.array(F.lit("email"), F.lit("push"), F.lit("sms"))).alias("channel"))
    failed = ((F.col("channel") == "sms") & (F.col("event_id") % 2 == 0)) | ((F.col("channel") == "email") & (F.col("event_id") % 5 == 0))
    return each.withColumn("status", F.when(failed, "FAILED").otherwise("SENT")).groupBy("event_type", "channel", "status").agg(F.count(F.lit(1)).alias("n"))


def _resumed(s, d):
    """Chunks of 20 trading days whose results are not yet there: a run stopped after 1998 goes on behind it."""
    days = panel.calendar(panel.bars(s, d))
    parts = pv.chunks(days, 20)
    return pv.open_chunks(parts, parts.where("end_d <= date'1998-12-31'"))


def _resume_marker(s, d):
    """Where a backfill goes on, by the source in the stored rows' metadata: the day after the last one."""
    rows = predictions(s, d).select("d", F.to_json(F.struct(F.when(F.col("horizon") == 3, "backfill").otherwise("daily").alias("source"))).alias("metadata"), "horizon").where("d <= date'1999-12-31' or horizon <> 3")
    return rows.groupBy(F.get_json_object("metadata", "$.source").alias("source")).agg(F.date_add(F.max("d"), 1).alias("next_d"), F.count(F.lit(1)).alias("stored"))


def _screened(s, d):
    p = Screen.of({"limit": "5000", "high": "66.5", "low": "x", "suggested": "maybe", "search": "  0 "})
    x = ind.rsi_columns(panel.bars(s, d)).select("asset_id", "d", sc.four(F.col("rsi")).alias("rsi"))
    x = pit.latest(x, "asset_id", "d").join(panel.assets(s, d).select("asset_id", "symbol"), "asset_id")
    return x.where((F.col("rsi") >= p.high) | (F.col("rsi") <= p.low)).where(F.lower("symbol").contains(p.search.lower())).orderBy(F.desc("rsi"), "asset_id").limit(p.limit).select("asset_id", "d", "rsi")


def _aligned(s, d):
    run = Backtest(date(1997, 1, 1), date(1998, 12, 31), horizon=3, metric="up_prob_30d").aligned()
    if wrong := run.checked():
        raise ValueError("; ".join(wrong))
    picks = predictions(s, d).where(F.col("horizon") == run.horizon).where(F.col("d").between(str(run.start), str(run.end)))
    return sc.top_k(picks, run.top, F.desc("up"), F.asc("asset_id")).select("d", "rank", "asset_id", "up")


def _stored(s, d):
    """A logistic model saved to the shared folder and loaded again: rows whose prediction is the same by both."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    moves = pit.next_row(panel.bars(s, d), 7).where("exit_d is not null").withColumn("label", (F.col("exit_c") > F.col("c")).cast("double"))
    x = moves.join(ind.rsi_columns(panel.bars(s, d)).select("asset_id", "d", "rsi"), ["asset_id", "d"]).select("asset_id", "d", "rsi", "v", "label")
    model = Pipeline(stages=[VectorAssembler(inputCols=["rsi", "v"], outputCol="features"), LogisticRegression(maxIter=5)]).fit(x)
    path = scratch_path(s, "model")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path).transform(x).select("asset_id", "d", F.col("prediction").alias("loaded"))
    both = model.transform(x).select("asset_id", "d", "prediction").join(back, ["asset_id", "d"])
    return both.groupBy((F.col("prediction") == F.col("loaded")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def _training_rows(s, d):
    """Training: the feature matrix of two years, of assets that were members of an index on the day."""
    days = panel.calendar(panel.shared_bars(s, d))
    members = pit.members_on(days, panel.membership(days, panel.assets(s, d)))
    return ft.point_in_time(feature_matrix(s, d), members, "1996-01-01", "1997-12-31")


def _point(s, d):
    """Serving: the newest row of the feature matrix at or before a day, of each asset."""
    return pit.latest(feature_matrix(s, d).where("d <= date'1999-06-30'"), "asset_id", "d").select("asset_id", "d", "rsi", "ret_5", "rs_score", "composite", "sentiment", "pmi")


def _report(s, d):
    """A capped report as it is read back from its CSV file; the cap is the report's."""
    x = panel.fundamentals(s, d).select("asset_id", "report_date", "pb")
    path = scratch_path(s, "report")
    sinks.report(x, path, 50, "asset_id", "report_date")
    return s.read.csv(path, header=True, schema="asset_id long, report_date date, pb long")


def _created(s, d):
    """Get or create, then update: an existing row keeps its creation day, both get the new value."""
    bars = panel.bars(s, d)
    old = bars.where("d < date'1998-01-01'").groupBy("asset_id").agg(F.min("d").alias("created"), F.max_by("c", "d").alias("value"))
    new = bars.where("d >= date'1997-10-01' and v > 40").groupBy("asset_id").agg(F.min("d").alias("created_new"), F.max_by("c", "d").alias("new"))
    both = old.join(new, "asset_id", "full")
    return both.select("asset_id", F.coalesce("created", "created_new").alias("created"), F.coalesce("new", "value").alias("value"))


def _mids(s, d):
    """Quotes as one rate: the mean of bid and ask where both are there, else the one that is."""
    q = panel.table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 500 + 100).alias("bid"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_custkey") % 500 + 104).alias("ask"))
    return q.select("c_custkey", sc.four(F.when(F.col("bid").isNotNull() & F.col("ask").isNotNull(), (F.col("bid") + F.col("ask")) / 2.0).otherwise(F.coalesce("bid", "ask") / 1.0) / 100.0).alias("rate"))


QUERIES = {
    "s3_recent_rows": (
        lambda s, d: sc.top_k(panel.bars(s, d), 30, F.desc("d"), by="asset_id").select("asset_id", "d", "c", "v"),
        sql("bars", "select asset_id, d, c, v from (select *, row_number() over (partition by asset_id order by d desc) as r from bars) where r <= 30"),
    ),
    "s13_margin_last_wins": (
        lambda s, d: pv.last_wins(panel.table(s, d, "lineitem").select(F.col("l_suppkey").alias("asset_id"), F.to_date("l_shipdate").alias("d"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("long").alias("line"), F.floor(F.col("l_extendedprice")).alias("balance"), F.floor(F.col("l_tax") * 100 + 0.5).alias("repaid")), ["asset_id", "d"], "seq", "line", "balance").select("asset_id", "d", "balance", "repaid"),
        "select l_suppkey as asset_id, cast(l_shipdate as date) as d, arg_max(cast(floor(l_extendedprice) as bigint), (l_orderkey, l_linenumber, cast(floor(l_extendedprice) as bigint))) as balance, arg_max(cast(floor(l_tax * 100 + 0.5) as bigint), (l_orderkey, l_linenumber, cast(floor(l_extendedprice) as bigint))) as repaid from lineitem group by 1, 2",
    ),
    "s14_macro_primary": (
        lambda s, d: pv.mapped(_macro_raw(s, d)[0], MACRO["primary"]),
        sql("macro", "select date, pmi, cpi10 from macro where month(date) <> 5"),
    ),
    "s15_macro_fallback": (
        _macro_filled,
        sql("macro", "select date, case when month(date) <> 5 and pmi is not null then pmi else coalesce(pmi, 50) + 1 end as pmi, case when month(date) <> 5 then cpi10 end as cpi10 from macro"),
    ),
    "s17_news_dispatch": (_news, sql("news", f"with {NEWS_SQL}")),
    "k3_get_or_create": (
        _created,
        sql("bars", "with o as (select asset_id, min(d) as created, arg_max(c, d) as value from bars where d < date '1998-01-01' group by 1), n as (select asset_id, min(d) as created, arg_max(c, d) as value from bars where d >= date '1997-10-01' and v > 40 group by 1) select coalesce(o.asset_id, n.asset_id) as asset_id, coalesce(o.created, n.created) as created, coalesce(n.value, o.value) as value from o full join n on o.asset_id = n.asset_id"),
    ),
    "k4_report": (_report, sql("fundamentals", "select asset_id, report_date, pb from fundamentals order by asset_id, report_date limit 50")),
    "k6_stored_model": (_stored, sql("bars", "select true as same, count(*) as n from bars b where exists (select 1 from bars e where e.asset_id = b.asset_id and e.d >= b.d + 7 and e.d <= b.d + 14)")),
    "p5_mean_asset_sentiment": (
        lambda s, d: asset_week(s, d).where("published = date'1996-03-04'").agg(F.count(F.lit(1)).alias("assets"), F.floor(F.sum(F.floor(F.col("x") * 1000000 + 0.5)) / (F.count(F.lit(1)) * 100.0) + 0.5).alias("mean_e4")),
        sql("news", f"with {SENT.strip()}, {ASSET_WEEK} select count(*) as assets, cast(floor(cast(sum(cast(floor(x * 1000000 + 0.5) as bigint)) as double) / (count(*) * 100.0::double) + 0.5) as bigint) as mean_e4 from aw where published = date '1996-03-04'"),
    ),
    "p13_event_tag": (
        lambda s, d: _impacts(s, d).where("event_tag = 'trade_war'").select("event_tag", "month", "impact_bp"),
        sql("macro", "select 'trade_war' as event_tag, date as month, y10 - y2 as impact_bp from macro where month(date) % 3 = 1"),
    ),
    "p15_screen_parameters": (
        _screened,
        sql("bars assets", f"with {RSI.strip()}, x as (select asset_id, max(d) as d, arg_max({r4('rsi')}, d) as rsi from rsi group by 1) select asset_id, d, rsi from x join assets using (asset_id) where (rsi >= 66.5 or rsi <= 30) and contains(lower(symbol), '0') order by rsi desc, asset_id limit 100"),
    ),
    "m10_training_rows": (
        _training_rows,
        sql("bars assets calendar membership fundamentals flows macro news", f"{MATRIX_ROWS}, {MEMBERS.strip()} select matrix.* from matrix join on_day o on o.d = matrix.d and o.asset_id = matrix.asset_id where matrix.d between date '1996-01-01' and date '1997-12-31'"),
    ),
    "m11_point_features": (
        _point,
        sql("bars fundamentals flows macro news", f"{MATRIX_ROWS} select asset_id, d, rsi, ret_5, rs_score, composite, sentiment, pmi from (select *, row_number() over (partition by asset_id order by d desc) as newest from matrix where d <= date '1999-06-30') where newest = 1"),
    ),
    "m27_mid_rates": (
        _mids,
        f"with q as (select c_custkey, case when c_custkey % 4 <> 0 then c_custkey % 500 + 100 end as bid, case when c_custkey % 6 <> 0 then c_custkey % 500 + 104 end as ask from customer) select c_custkey, {r4('(case when bid is not null and ask is not null then (bid + ask) / 2.0::double else coalesce(bid, ask) / 1.0::double end) / 100.0::double')} as rate from q",
    ),
    "r3_notifications": (
        _notices,
        ALERTS.replace("select event_type, event_id from f", "select event_type, channel, case when (channel = 'sms' and event_id % 2 = 0) or (channel = 'email' and event_id % 5 = 0) then 'FAILED' else 'SENT' end as status, count(*) as n from f, (values ('email'), ('push'), ('sms')) as ch(channel) group by 1, 2, 3"),
    ),
    "r5_backward_windows": (
        lambda s, d: pv.backward_windows(panel.news(s, d).select(F.col("published").alias("d")).where("d >= date'1997-03-01'"), "2000-01-01", "1995-01-01", 90),
        sql("news", "with k as (select coalesce(min(published) - 1, date '2000-01-01') as last from news where published >= date '1997-03-01'), w as (select i as step, last - cast(i * 90 as integer) as end_d from k, generate_series(0, 100) as g(i)) select cast(step as integer) as step, greatest(end_d - 89, date '1995-01-01') as start_d, end_d from w where end_d >= date '1995-01-01'"),
    ),
    "r8_open_chunks": (
        _resumed,
        sql("calendar", "with n as (select d, (row_number() over (order by d) - 1) // 20 as chunk from calendar) select chunk, min(d) as start_d, max(d) as end_d, count(*) as n from n group by 1 having max(d) > date '1998-12-31'"),
    ),
    "r10_resume_marker": (
        _resume_marker,
        sql("bars fundamentals flows macro news", f"{HEURISTIC} select case when horizon = 3 then 'backfill' else 'daily' end as source, max(d) + 1 as next_d, count(*) as stored from hq where d <= date '1999-12-31' or horizon <> 3 group by 1"),
    ),
    "b5_aligned_horizon": (
        _aligned,
        sql("bars fundamentals flows macro news", f"{HEURISTIC} select d, rank, asset_id, up from (select *, row_number() over (partition by d order by up desc, asset_id) as rank from hq where horizon = 30 and d between '1997-01-01' and '1998-12-31') where rank <= 3"),
    ),
}
