"""Backtest runs and index series side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison as cmp
from ..operators import scoring as sc
from ..sources import panel
from ..sources.scratch import scratch_path
from .composites import backtest, backtest_curve, backtest_sql
from .cte import CTE
from .windows import r4

#: Comparisons of the runs: which series they hold, and whose days count.
MEMBERS = [(1, "run-1", True), (1, "run-2", False), (1, "run-3", False), (1, "IDX_A", False), (1, "IDX_B", False), (2, "run-3", True), (2, "run-1", False), (2, "IDX_B", False)]


def _curves(s, d):
    """The runs' equity by trading day, one index by weekday and one by month: three calendars."""
    runs = backtest_curve(backtest(s, d)).select(F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("series"), "d", F.col("equity_cents").alias("value"))
    # the runs have the panel kept: both indices are one pass over it, and no line is shuffled again
    x = panel.shared_bars(s, d).join(panel.assets(s, d).select("asset_id", F.explode("tags").alias("series")), "asset_id")
    x = x.where("series <> 'IDX_A' or weekday(d) < 5").withColumn("since", F.when(F.col("series") == "IDX_A", F.col("d")).otherwise(F.trunc("d", "MM")))
    indices = x.groupBy("series", "since").agg(F.min("d").alias("d"), F.sum("c").alias("value")).drop("since")
    path = scratch_path(s, "curves")  # a row a series and day, read for the days, the base and the values
    rows = runs.unionByName(indices)
    rows.write.parquet(path)
    return s.read.schema(rows.schema).parquet(path)


def _members(s):
    return s.createDataFrame(MEMBERS, "comparison_id long, series string, selected boolean")


def run_comparison(s, d):
    x = cmp.compared(_members(s), _curves(s, d))
    return x.select("comparison_id", "series", "d", F.floor(F.col("value") + 0.5).alias("value_cents"), sc.four(F.col("drawdown")).alias("drawdown"))


def run_summaries(s, d):
    x = cmp.summary(cmp.compared(_members(s), _curves(s, d)))
    return x.select("comparison_id", "series", "days", "first_d", "last_d", sc.four(F.col("total_return")).alias("total_return"), sc.four(F.col("max_drawdown")).alias("max_drawdown"))


COMPARED = f""",{CTE['assets']},
mb as (select comparison_id::bigint as comparison_id, series, selected from (values {', '.join(str(m) for m in MEMBERS)}) as t(comparison_id, series, selected)),
cu as materialized (select 'run-' || run_id as series, d, cast(floor(equity * 100 + 0.5) as bigint) as value from curve
       union all select 'IDX_A', d, cast(sum(c) as bigint) from bars join assets using (asset_id) where list_contains(tags, 'IDX_A') and isodow(d) <= 5 group by d
       union all select 'IDX_B', min(d), cast(sum(c) as bigint) from bars join assets using (asset_id) where list_contains(tags, 'IDX_B') group by date_trunc('month', d)),
da as (select comparison_id, d, value as level from mb join cu using (series) where selected),
fi as (select comparison_id, series, min(d) as first from mb join cu using (series) group by 1, 2),
sa as (select fi.comparison_id, max(first) as start from fi join (select comparison_id, max(d) as last from da group by 1) l using (comparison_id) where first <= last group by 1),
ba as (select comparison_id, min(d) as base_d, arg_min(level, d) as level from da join sa using (comparison_id) where d >= start group by 1),
gr as (select mb.comparison_id, mb.series, da.d, ba.level from da join ba using (comparison_id) join mb using (comparison_id) where da.d >= base_d),
al as (select gr.comparison_id, gr.series, gr.d, gr.level, cu.value::double as value from gr asof join cu on cu.series = gr.series and gr.d >= cu.d),
sl as (select comparison_id, series, d, value * level / first_value(value) over (partition by comparison_id, series order by d) as value from al),
dd as (select *, value / max(value) over (partition by comparison_id, series order by d) - 1 as drawdown from sl)
"""

QUERIES = {
    "b14_run_comparison": (
        run_comparison,
        backtest_sql(f"{COMPARED} select comparison_id, series, d, cast(floor(value + 0.5) as bigint) as value_cents, {r4('drawdown')} as drawdown from dd"),
    ),
    "b14_run_summaries": (
        run_summaries,
        backtest_sql(f"{COMPARED} select comparison_id, series, count(*) as days, min(d) as first_d, max(d) as last_d, {r4('arg_max(value, d) / arg_min(value, d) - 1')} as total_return, {r4('min(drawdown)')} as max_drawdown from dd group by 1, 2"),
    ),
}
