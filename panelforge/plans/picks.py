"""Candidates of runs of every strategy, mode and scope over two prediction sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import picks as pk
from ..operators import scoring as sc
from ..sources import panel
from .cte import sql
from .scores import DECIDE, HEURISTIC, INPUTS, macro_months, predicted, scored
from .windows import r4

#: run_id, strategy, mode, metric, scope, source, horizon, up_threshold, threshold, top_n, max_positions, macro
RUNS = [
    (1, "bottom", "top_n", "up", "independent", "heuristic", 7, 0.55, 0.6, 5, 20, True),
    (2, "prediction", "top_n", "up", "independent", "heuristic", 7, 0.36, 0.0, 5, 20, False),
    (3, "prediction", "top_n", "trade_score", "independent", "heuristic", 7, 0.36, 0.0, 4, 20, True),
    (4, "prediction", "trade_score", "up", "independent", "technical", 7, 0.3, 0.5, 5, 3, False),
    (5, "prediction", "trade_score", "up", "combined", "heuristic", 7, 0.2, 0.3, 5, 6, True),
    (6, "prediction", "trade_score", "up", "combined", "heuristic", 7, 0.3, 0.6, 5, 2, False),
]
COLUMNS = "run_id long, strategy string, mode string, metric string, scope string, source string, horizon int, up_threshold double, threshold double, top_n int, max_positions int, macro boolean"


def scores(s, d):
    """Up probability and trade score at seven days of the heuristic and of technical reversal, their mean, and factors."""
    # gain and loss look at an asset's bars alone: they are there before the ranks of the day, and all sources are one row
    more = lambda rows: sc.bounds(sc.decision_columns(rows).withColumn("horizon", F.lit(7))).withColumn("reversal", F.col("score"))
    x = predicted(scored(s, d, None, "gain", "loss", "reversal", more=more).withColumn("horizon", F.lit(7)))
    trade = {c: F.when(F.col(c).isNotNull(), sc.four(sc.trade_score(F.col(c)))) for c in ("up", "reversal")}
    x = x.withColumns({f"_{c}": v for c, v in trade.items()})
    row = lambda source, up, value, horizon=7: F.struct(F.lit(source).alias("source"), F.lit(horizon).alias("horizon"), up.cast("double").alias("up"), value.alias("trade_score"))
    sources = F.array(
        row("heuristic", F.col("up"), F.col("_up")), row("technical", F.col("reversal"), F.col("_reversal")),
        row(pk.COMBINED, pk.combined_value(F.col("up"), F.col("reversal")), pk.combined_value(F.col("_up"), F.col("_reversal"))), row(pk.FACTOR, F.lit(None), F.col("bottom"), 0),
    )
    x = x.select("asset_id", "d", F.explode(F.filter(sources, lambda r: (r["source"] != "heuristic") | r["up"].isNotNull())).alias("r"))
    return x.select("r.source", "r.horizon", "asset_id", "d", "r.up", "r.trade_score")


def picked(s, d):
    phases = macro_months(s, d).select(F.col("date").alias("month"), "phase")
    return pk.picked(s.createDataFrame(RUNS, COLUMNS), scores(s, d), phases, most=max(max(r[9], r[10]) for r in RUNS))


_MULTIPLIER = "case when macro then (case phase " + " ".join(f"when '{p}' then {a}::double + {b}::double * greatest(0.0::double, up - {c}::double)" for p, (a, b, c) in sc.PHASE_MULTIPLIER.items()) + " else 1.0::double end) else 1.0::double end"
_E4 = "sum(cast(floor({0} * 10000 + 0.5) as bigint))::double / (count({0}) * 10000.0::double)"
PICKED = f"""{HEURISTIC}, {INPUTS.strip()},
sr as (select 'heuristic' as source, asset_id, d, horizon, up as p, label from hq where horizon = 7
       union all select 'technical', asset_id, d, 7, score, case when score >= 0.5 then 'UP' else 'FLAT' end from tech),
dj as (select di.*, mid + 2 * dev as upper, mid - 2 * dev as lower, cast(c as double) as k, c * 1.01::double as up1, source, horizon, p, label from sr join di on di.asset_id = sr.asset_id and di.d = sr.d), {DECIDE.strip()},
ss as (select source, horizon, asset_id, d, p as up, trade_score from decided
       union all select 'combined', horizon, asset_id, d, {_E4.format('p')}, {_E4.format('trade_score')} from decided group by horizon, asset_id, d
       union all select 'factor', 0, asset_id, d, null, bottom from factor),
ru as (select * from (values {', '.join(str(r) for r in RUNS)}) as t(run_id, strategy, mode, metric, scope, named, days, up_threshold, threshold, top_n, max_positions, macro)),
pc as (select run_id, d, asset_id, up, strategy = 'prediction' and macro as macro, case when strategy = 'prediction' and mode = 'trade_score' then max_positions else top_n end as cut,
              case when strategy = 'bottom' or mode = 'trade_score' or metric = 'trade_score' then trade_score else up end as value
       from ru join ss on ss.source = case when strategy = 'bottom' then 'factor' when mode = 'trade_score' and scope = 'combined' then 'combined' else named end and ss.horizon = case when strategy = 'bottom' then 0 else days end
       where (strategy = 'bottom' or up >= up_threshold::double) and ((strategy = 'prediction' and mode = 'top_n') or trade_score >= threshold::double)),
p1 as (select * from pc qualify row_number() over (partition by run_id, d order by value desc, asset_id) <= cut),
p2 as (select run_id, p1.d, asset_id, {r4(f'value * ({_MULTIPLIER})')} as value from p1 left join ph on ph.date = date_trunc('month', p1.d))
select run_id::bigint as run_id, d, row_number() over (partition by run_id, d order by value desc, asset_id) as rank, asset_id, value from p2"""

QUERIES = {"b3_run_candidates": (picked, sql("bars fundamentals flows macro news", PICKED))}
