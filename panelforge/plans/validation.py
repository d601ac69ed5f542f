"""The validation report by asset: ranges of missing bars, related rows that are missing, null and neutral fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import quality as ql
from ..sources import panel
from ..sources.scratch import scratch_path
from .cte import sql
from .scores import FACTORS, factors

SCORES = ("fundamental", "flow", "technical", "composite", "bottom")


def asset_ranges(s, d):
    """Runs of missing bars of active assets from their listing on."""
    bars = panel.bars(s, d)
    listed = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("asset_id") % 700).cast("int"))
    return ql.ranges(panel.assets(s, d).where("active").select("asset_id", listed.alias("list_date")), bars, panel.calendar(bars))


def asset_issues(s, d):
    """By asset: bars without flows, factors or RSI, fundamentals without a pe, factors at their neutral default."""
    bars, parts = panel.shared_bars(s, d), panel.parts(s, d)
    path = scratch_path(s, "factors")  # read for their rows and for their values
    scored = factors(s, d).select("asset_id", "d", *SCORES)
    scored.write.parquet(path)
    scored = s.read.schema(scored.schema).parquet(path)
    related = {"flow": panel.flows(s, d), "factor": scored, "indicator": ind.rsi_columns(bars).where("rsi is not null")}
    reports = panel.fundamentals(s, d).withColumnRenamed("report_date", "d")
    return ql.missing_related(bars, related, parts).unionByName(ql.fields(reports, "fundamental", nulls=["pe"], parts=parts)).unionByName(ql.fields(scored, "factor", neutral=list(SCORES), parts=parts))


RANGES = """with al as (select asset_id, date '1995-01-02' + cast(asset_id % 700 as integer) as list_date from assets where active),
ho as (select al.asset_id, c.d, b.asset_id is not null as here from al join calendar c on c.d >= list_date left join bars b on b.asset_id = al.asset_id and b.d = c.d),
ru as (select *, row_number() over (partition by asset_id order by d) - row_number() over (partition by asset_id, here order by d) as g from ho)
select asset_id, min(d) as gap_start, max(d) as gap_end, count(*) as missing from ru where not here group by asset_id, g"""
ISSUES = f"""{FACTORS}, rl as (select 'flow' as source, asset_id, d from flows union all select 'factor', asset_id, d from factor union all select 'indicator', asset_id, d from rsi where rsi is not null),
mi as (select asset_id, 'missing_related' as issue, source, '' as field, d from bars b, (values ('flow'), ('factor'), ('indicator')) as t(source) where not exists (select 1 from rl where rl.source = t.source and rl.asset_id = b.asset_id and rl.d = b.d)),
al as (select * from mi union all select asset_id, 'null_field', 'fundamental', 'pe', report_date from fundamentals where pe is null
       {' '.join(f"union all select asset_id, 'neutral_default', 'factor', '{c}', d from factor where {c} = 0.5" for c in SCORES)})
select asset_id, issue, source, field, count(*) as n, min(d) as first_d, max(d) as last_d from al group by 1, 2, 3, 4"""

QUERIES = {
    "qg_asset_ranges": (asset_ranges, sql("bars assets calendar", RANGES)),
    "qg_asset_issues": (asset_issues, sql("bars fundamentals flows", ISSUES)),
}
