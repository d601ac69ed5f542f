"""Onboarding of universes: versions, what the newest snapshot changes, and what new members lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import universe as un
from ..sources import panel
from ..sources.scratch import scratch_path
from .cte import sql

#: Least volume a month of an asset of the index LARGE, and volume a step of weight.
LARGE, STEP = 180, 100


def snapshots(s, d):
    """Snapshots by month from traded volume: an asset is in LARGE or in SMALL, and in none where it did not trade."""
    v = panel.bars(s, d).groupBy("asset_id", F.trunc("d", "MM").alias("trade_date")).agg(F.sum("v").alias("v"))
    code = F.when(F.col("v") >= LARGE, "LARGE").otherwise("SMALL")
    return v.select(code.alias("index_code"), "trade_date", "asset_id", F.floor(F.col("v") / STEP).alias("weight"))


def _split(s, d):
    """The versions before each index's newest snapshot, and that snapshot."""
    x = _written(s, snapshots(s, d), "snapshots")
    last = x.groupBy("index_code").agg(F.max("trade_date").alias("last"))  # one row an index
    x = x.join(last, "index_code")
    return _written(s, un.versions(x.where("trade_date < last").drop("last")), "versions"), x.where("trade_date = last").drop("last")


def _written(s, rows, name):
    """The table of ``rows``: what a rollout keeps, and what later steps read several times."""
    path = scratch_path(s, name)
    rows.write.parquet(path)
    return s.read.schema(rows.schema).parquet(path)


def universe_diff(s, d):
    stored, newest = _split(s, d)
    return un.diff(stored, newest)


def universe_versions(s, d):
    """The newest snapshot applied, twice: the second time changes nothing."""
    stored, newest = _split(s, d)
    once = _written(s, un.applied(stored, un.diff(stored, newest)), "applied")
    return un.applied(once, un.diff(once, newest))


def onboarding_worklist(s, d):
    """What assets that entered an index with the newest snapshot lack: bars and flows by trading day, fundamentals by month."""
    stored, newest = _split(s, d)
    bars = panel.bars(s, d)
    days = panel.calendar(bars)
    monthly = days.select(F.lit("fundamentals").alias("source"), F.trunc("d", "MM").alias("d")).distinct()
    wanted = days.select(F.explode(F.array(F.lit("bars"), F.lit("flows"))).alias("source"), "d").unionByName(monthly)
    reports = panel.fundamentals(s, d).select("asset_id", F.col("report_date").alias("d"))
    tables = {"bars": bars, "flows": panel.flows(s, d), "fundamentals": reports}
    opened = un.diff(stored, newest).where("change = 'opened'").select("asset_id")
    return un.worklist(opened, wanted, tables)


SNAPSHOTS = f"""with sv as (select asset_id, cast(date_trunc('month', d) as date) as trade_date, cast(sum(v) as bigint) as v from bars group by 1, 2),
sn as materialized (select case when v >= {LARGE} then 'LARGE' else 'SMALL' end as index_code, trade_date, asset_id, v // {STEP} as weight from sv),
sd as (select *, row_number() over w as no, lead(trade_date) over w as following, max(trade_date) over (partition by index_code) as last from (select distinct index_code, trade_date from sn) window w as (partition by index_code order by trade_date))"""


def _versions(name: str, where: str, following: str) -> str:
    return f"""{name}_b as (select sn.*, {following} as following, no, case when lag(no) over w = no - 1 and lag(weight) over w = weight then 0 else 1 end as begins from sn join sd using (index_code, trade_date) where {where} window w as (partition by index_code, asset_id order by trade_date)),
{name}_s as (select *, sum(begins) over (partition by index_code, asset_id order by trade_date) as span from {name}_b),
{name} as (select index_code, asset_id, max(weight) as weight, min(trade_date) as valid_from, arg_max_null(following, trade_date) - 1 as valid_to from {name}_s group by index_code, asset_id, span)"""


DIFF = f"""{SNAPSHOTS}, {_versions('ov', 'trade_date < last', 'case when following < last then following end')},
nw as (select sn.index_code, asset_id, weight, trade_date from sn join sd using (index_code, trade_date) where trade_date = last),
lt as (select index_code, last as as_of from sd where trade_date = last),
df as (select * from (select coalesce(o.index_code, n.index_code) as index_code, coalesce(o.asset_id, n.asset_id) as asset_id,
         case when o.asset_id is null then 'opened' when n.asset_id is null then 'closed' when o.weight <> n.weight then 'changed' end as change, o.weight as old_weight, n.weight as weight
       from (select * from ov where valid_to is null) o full join nw n on n.index_code = o.index_code and n.asset_id = o.asset_id) join lt using (index_code) where change is not null)"""

QUERIES = {
    "qi_universe_diff": (universe_diff, sql("bars", f"{DIFF} select index_code, asset_id, change, old_weight, weight, as_of from df")),
    "qi_universe_versions": (universe_versions, sql("bars", f"{SNAPSHOTS}, {_versions('av', 'true', 'following')} select * from av")),
    "qi_onboarding_worklist": (
        onboarding_worklist,
        sql(
            "bars calendar fundamentals flows",
            f"{DIFF}, op as (select distinct asset_id from df where change = 'opened'), wa as (select 'bars' as source, d from calendar union all select 'flows', d from calendar union all select distinct 'fundamentals', cast(date_trunc('month', d) as date) from calendar), "
            "du as (select source, count(*) as wanted from wa group by 1), hv as (select 'bars' as source, asset_id, d from bars union all select 'flows', asset_id, d from flows union all select 'fundamentals', asset_id, report_date from fundamentals), "
            "ct as (select source, asset_id, count(*) as stored, min(d) as first_d, max(d) as last_d from hv semi join wa on wa.source = hv.source and wa.d = hv.d group by 1, 2) "
            "select op.asset_id, du.source, wanted, coalesce(stored, 0) as stored, first_d, last_d from op cross join du left join ct on ct.asset_id = op.asset_id and ct.source = du.source where coalesce(stored, 0) < wanted",
        ),
    ),
}
