"""Queries of scores and trade decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators import crosssection as cs
from ..operators import indicators as ind
from ..operators import pointintime as pit
from ..operators import scoring as sc
from ..operators import signals as sig
from ..sources import panel
from . import lexicon
from .cte import sql
from .relational import SENT
from .windows import SIGNALS, W, mean_sql, r4, spread_sql


def case(column: str, table: dict, default, k: int | None = None) -> str:
    pick = lambda v: v if k is None else v[k]
    key = lambda x: f"'{x}'" if isinstance(x, str) else x
    return "case " + " ".join(f"when {column} = {key(x)} then {pick(v)}::double" for x, v in table.items()) + f" else {default}::double end"


def macro_months(s, d):
    m = panel.macro(s, d).where("pmi is not null")
    from pyspark.sql import Window

    slope = F.col("pmi") - F.lag("pmi").over(Window.orderBy("date"))  # one row a month
    return m.withColumn("slope", slope).withColumn("phase", sc.phase(F.col("pmi"), F.col("slope"), F.col("non_pmi"), F.col("cpi10") / 10.0))


PHASES = """
ph as (select *, case when pmi < 50 and slope < 0 then 'RECESSION' when pmi < 50 and cpi10 / 10.0::double > 2.5 then 'STAGFLATION'
                      when pmi >= 52 and non_pmi >= 53 then 'OVERHEAT' else 'RECOVERY' end as phase
       from (select *, pmi - lag(pmi) over (order by date) as slope from macro where pmi is not null))"""

TECH = f"""{SIGNALS},
tech as (select asset_id, d, least(100, case when rsi <= 35 then 35 else 0 end + case when c * 100 <= 103 * lower then 25 else 0 end
                + 40 * max(case when {sig.RULES['OVERSOLD_COMBINATION']} then 1 else 0 end) over ({W})) / 100.0::double as score from sig_b)"""

FACTORS = f"""{TECH},
days as (select asset_id, d from bars),
qoq as (select *, roe_bp - lag(roe_bp) over (partition by asset_id order by report_date) as roe_qoq_bp from fundamentals),
fw as (select asset_id, d, cast(sum(lg_buy - lg_sell) over ({W} rows between 4 preceding and current row) as bigint) as main_force_5d, balance - lag(balance, 5) over ({W}) as margin_change_5d from flows),
fx as (select days.asset_id, days.d, q.pe, q.pb, q.roe_qoq_bp, w.main_force_5d, w.margin_change_5d, t.score from days
       asof left join qoq q on days.asset_id = q.asset_id and days.d >= q.available_date
       left join (select days.asset_id, days.d, fw.main_force_5d, fw.margin_change_5d from days asof left join fw on days.asset_id = fw.asset_id and days.d >= fw.d) w on w.asset_id = days.asset_id and w.d = days.d
       left join tech t on t.asset_id = days.asset_id and t.d = days.d),
fr as (select *, {', '.join(f"case when {c} is not null then cast(count({c}) over (partition by d order by {c} range between unbounded preceding and current row) as double) / count({c}) over (partition by d) end as {c}_rank" for c in ('pe', 'pb', 'main_force_5d', 'margin_change_5d'))},
              case when roe_qoq_bp is not null then greatest(0.0::double, least(1.0::double, (roe_qoq_bp / 10000.0::double + 0.2::double) / 0.4::double)) end as roe_score from fx),
fa as (select *, case when pe_rank is null and pb_rank is null and roe_score is null then 0.5::double else
                 (coalesce(1 - pe_rank, 0.0::double) + coalesce(1 - pb_rank, 0.0::double) + coalesce(roe_score, 0.0::double)) / ((pe_rank is not null)::int + (pb_rank is not null)::int + (roe_score is not null)::int) end as fundamental,
              case when main_force_5d_rank is null and margin_change_5d_rank is null then 0.5::double else
                 (coalesce(main_force_5d_rank, 0.0::double) + coalesce(margin_change_5d_rank, 0.0::double)) / ((main_force_5d_rank is not null)::int + (margin_change_5d_rank is not null)::int) end as flow,
              coalesce(score, 0.0::double) as technical from fr),
factor as materialized (select asset_id, d, {r4('1 - pe_rank')} as pe_percentile, {r4('1 - pb_rank')} as pb_percentile, {r4('roe_score')} as roe_trend, {r4('main_force_5d_rank')} as main_force, {r4('margin_change_5d_rank')} as margin,
                  {r4('fundamental')} as fundamental, {r4('flow')} as flow, {r4('technical')} as technical,
                  {r4('0.4::double * fundamental + 0.3::double * flow + 0.3::double * technical')} as composite,
                  {r4('greatest(0.0::double, least(1.0::double, 0.4::double * fundamental + 0.3::double * flow + 0.3::double * technical))')} as bottom from fa)"""


def newest_days(s, d):
    """d: the days that are some asset's newest; ranks of a day are over all assets, so these days suffice for newest rows."""
    return panel.shared_bars(s, d).groupBy("asset_id").agg(F.max("d").alias("d")).select("d").distinct()


def factors(s, d, days=None):
    """Factor scores of all days, or of ``days`` (d, no more than the calendar has)."""
    return _factors(s, d, sc.technical_column(panel.shared_panel(s, d)), days)


def _factors(s, d, rows, days, *keep):
    """Factor scores of ``rows`` of the shared panel with their technical score, and the ``keep`` columns."""
    rows = rows.select("asset_id", "d", "score", "main_force_5d", "margin_change_5d", *keep)
    if days is not None:
        rows = rows.join(F.broadcast(days), "d", "left_semi")
    return sc.factor_scores(rows, panel.fundamentals(s, d), panel.parts(s, d))


def decisions_in(s, d):
    """Latest decision inputs of each asset, by horizon, with probabilities from its id and horizon."""
    x = pit.latest(sc.decision_inputs(panel.bars(s, d)), "asset_id", "d")
    h = s.createDataFrame([(3,), (7,), (30,)], "horizon int")
    x = x.crossJoin(F.broadcast(h))
    p = (30 + (F.col("asset_id") * 7 + F.col("horizon")) % 60) / 100.0
    return x.withColumn("p", p).withColumn("label", F.when(F.col("p") >= 0.5, "UP").otherwise("FLAT"))


INPUTS = f"""
di as (select asset_id, d, c, max(h) over w20 as high20, max(h) over w60 as high60, min(l) over w20 as low20, min(l) over w60 as low60,
              {mean_sql('c', 20)} as mid, {spread_sql('c', 20)} as dev, coalesce({mean_sql('c', 60)}, {mean_sql('c', 50)}) as average, row_number() over (partition by asset_id order by d desc) as newest
       from bars window w20 as ({W} rows between 19 preceding and current row), w60 as ({W} rows between 59 preceding and current row))"""
# from dj: di with upper, lower, k (its close), up1 (1.01 of it), horizon, p and label
DECIDE = f"""
dk as (select *, case when up1 < 10 then 0.5::double when up1 < 50 then 1.0::double when up1 < 100 then 2.0::double when up1 < 500 then 5.0::double else 10.0::double end as step from dj),
dl as (select *, coalesce(list_min(list_filter([high20::double, high60::double, upper, ceil(up1 / step) * step], lambda v: v > k)), k * (1 + {case('horizon', sc.TARGET_FALLBACK, 0.05)})) as t0,
              coalesce(list_max(list_filter([low20::double, low60::double, lower, average], lambda v: v < k)), k * (1 - {case('horizon', sc.STOP_FALLBACK, 0.03)})) as s0 from dk),
dm as (select *, greatest(t0 - k, k * 0.005::double) as w, greatest(k - s0, k * 0.005::double) as q from dl),
decided as (select * exclude (w, q, t0, s0), {r4('t0')} as target, {r4('s0')} as stop, {r4('w / q')} as reward_risk,
                   {r4('p * w / (greatest(0.05::double, 1 - p) * q)')} as trade_score, label = 'UP' and w / q >= 1.5 and p * w / (greatest(0.05::double, 1 - p) * q) >= 1 as suggested from dm)"""
DECISIONS = f"""{INPUTS},
dh as (select *, mid + 2 * dev as upper, mid - 2 * dev as lower, cast(c as double) as k, c * 1.01::double as up1, (30 + (asset_id * 7 + horizon) % 60) / 100.0::double as p
       from di, (values (3), (7), (30)) as hz(horizon) where newest = 1),
dj as (select *, case when p >= 0.5 then 'UP' else 'FLAT' end as label from dh), {DECIDE.strip()}"""
DECIDED = ("asset_id", "d", "horizon", "c", "p", "label", "target", "stop", "reward_risk", "trade_score", "suggested")


def day_sentiment(s, d, days):
    """d, sentiment: the mean of the newest day with articles at or before each day, from exact sums; one row a day."""
    x = lexicon.sentiment(panel.news(s, d).select("article_id", "published", "text"))
    by = x.groupBy("published").agg(F.sum(F.floor(F.col("sentiment") * 1000000 + 0.5).cast("long")).alias("m"), F.count(F.lit(1)).alias("n"))
    by = by.select(F.lit(1).alias("market"), "published", sc.four(F.col("m") / (F.col("n") * 1000000.0)).alias("sentiment"))
    return pit.asof(days.withColumn("market", F.lit(1)), by, "market", "d", "published", "sentiment").select("d", "sentiment")


DAY_SENTIMENT = f"""{SENT.strip()},
ds as materialized (select published, {r4('cast(sum(cast(floor(s * 1000000 + 0.5) as bigint)) as double) / (count(*) * 1000000.0::double)')} as sentiment from sent group by 1),
da as materialized (select c.d, ds.sentiment from (select distinct d from bars) c asof join ds on c.d >= ds.published)"""


def scored(s, d, days=None, *keep, more=lambda rows: rows):
    """Every bar, or those of ``days``: factors, momentum, RS score, phase of the month, newest sentiment of the market.

    What looks back along an asset is worked out in the panel's own partitions and goes along to the ranks of the day, so
    nothing is joined by asset and day: ``keep`` names columns of the panel that go along, too, or that ``more`` adds.
    Momentum and RS score are null in an asset's first rows.  Sentiment and phase have one row a day or month, and are broadcast.
    """
    bars = sc.technical_column(panel.shared_panel(s, d))
    back = ind.lagged("c", 20)
    bars = bars.withColumns({"mom5": sc.four(ratio(F.col("c") - ind.lagged("c", 5), ind.lagged("c", 5))), "_ret": (F.col("c") - back) * 1.0 / back})
    x = _factors(s, d, more(bars), days, "mom5", "_ret", *keep).where("asset_id is not null and d is not null")
    x = x.withColumns(dict(zip(("_rank", "_n"), cs.day_rank("_ret"), strict=True)))
    x = x.withColumn("rs", F.when(F.col("_ret").isNotNull(), sc.four(1 - (F.col("_rank") - 1) / F.col("_n")))).drop("_ret", "_rank", "_n")
    bars = panel.shared_bars(s, d)
    months = macro_months(s, d).select(F.col("date").alias("month"), F.col("phase").alias("macro_phase"))
    x = x.withColumn("month", F.trunc("d", "MM")).join(F.broadcast(months), "month", "left").drop("month")
    x = x.join(F.broadcast(day_sentiment(s, d, panel.calendar(bars))), "d", "left")
    return x.withColumn("macro_phase", F.coalesce("macro_phase", F.lit(""))).withColumn("sentiment", F.coalesce("sentiment", F.lit(0.0)))


def heuristics_in(s, d, days=None, *keep, more=lambda rows: rows):
    """The rows of ``scored`` that have a momentum and an RS score, by horizon."""
    x = scored(s, d, days, *keep, more=more).where("mom5 is not null and rs is not null")
    x = x.select("asset_id", "d", "bottom", "mom5", "rs", "macro_phase", "sentiment", *keep)
    return x.crossJoin(F.broadcast(s.createDataFrame([(3,), (7,), (30,)], "horizon int")))


HEURISTIC = f"""{FACTORS},
hm as (select asset_id, d, {r4(f"cast(c - lag(c, 5) over ({W}) as double) / lag(c, 5) over ({W})")} as mom5 from bars),
h20 as (select asset_id, d, (c - lag(c, 20) over ({W})) * 1.0::double / lag(c, 20) over ({W}) as ret from bars),
hr as (select asset_id, d, {r4('1 - cast(row_number() over (partition by d order by ret desc, asset_id) - 1 as double) / count(*) over (partition by d)')} as rs from h20 where ret is not null),
{PHASES.strip()}, {DAY_SENTIMENT},
hx as (select f.asset_id, f.d, horizon, bottom, mom5, rs, coalesce(phase, '') as macro_phase, coalesce(da.sentiment, 0.0::double) as sentiment
       from factor f join hm on hm.asset_id = f.asset_id and hm.d = f.d join hr on hr.asset_id = f.asset_id and hr.d = f.d
       left join ph on ph.date = date_trunc('month', f.d) left join da on da.d = f.d, (values (3), (7), (30)) as hz(horizon) where mom5 is not null),
hs as (select *, 1.2::double * mom5 + 0.25::double * sentiment + 0.4::double * (rs - 0.5::double) - (bottom - 0.5::double) as s, {case('horizon', sc.HORIZON_SCALE, 1.0)} as k from hx),
hu as (select *, greatest(0.0::double, least(1.0::double, 0.33::double + k * s + case macro_phase when 'RECESSION' then -0.02::double when 'RECOVERY' then 0.03::double else 0.0::double end)) as u,
              greatest(0.0::double, least(1.0::double, 0.33::double - k * s + case macro_phase when 'RECESSION' then 0.04::double when 'RECOVERY' then -0.02::double else 0.0::double end)) as dn from hs),
hf as (select *, greatest(0.0::double, least(1.0::double, 1 - u - dn)) as f from hu),
hp as (select *, {r4('u / (u + dn + f)')} as up, {r4('f / (u + dn + f)')} as flat, {r4('dn / (u + dn + f)')} as down from hf),
hq as materialized (select *, list_reverse_sort([up, flat, down]) as o, case when up >= flat and up >= down then 'UP' when down >= up and down >= flat then 'DOWN' else 'FLAT' end as label from hp)"""


def predictions(s, d, days=None):
    return sc.heuristic(heuristics_in(s, d, days)).select("asset_id", "d", "horizon", "macro_phase", "up", "flat", "down", "label", "confidence")


def predicted(x):
    """Rows of ``scored`` with a horizon, and up, flat, down, label and confidence; null without a momentum or RS score."""
    x = sc.heuristic(x)
    known = F.col("mom5").isNotNull() & F.col("rs").isNotNull()
    return x.withColumns({c: F.when(known, F.col(c)) for c in ("up", "flat", "down", "label", "confidence")})


def prune_plan(importances):
    """keep: enough features for 80 % of the importance, between 20 and 25; one row a model."""
    from pyspark.sql import Window

    w = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    x = importances.withColumns({"rank": F.row_number().over(w), "cum": F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("importance").over(Window.partitionBy("model"))})
    need = [F.min(F.when(F.col("cum") * 100 >= share * F.col("total"), F.col("rank"))).alias(f"need_{share}") for share in (80, 85, 90)]
    out = x.groupBy("model").agg(*need, F.count(F.lit(1)).alias("n"))
    return out.withColumn("keep", F.least("n", F.greatest(F.lit(20), F.least(F.lit(25), "need_80"))).cast("int"))


def _importances(s, d):
    x = panel.table(s, d, "part").select((F.col("p_partkey") % 5).alias("model"), F.col("p_brand").alias("feature"), F.col("p_size").cast("long").alias("n"))
    return x.groupBy("model", "feature").agg(F.sum("n").alias("importance"))


IMPORTANCES = "imp as (select p_partkey % 5 as model, p_brand as feature, cast(sum(cast(p_size as bigint)) as bigint) as importance from part group by 1, 2)"

QUERIES = {
    "m1_technical_reversal": (lambda s, d: sc.technical_reversal(panel.bars(s, d)), sql("bars", f"{TECH} select asset_id, d, score from tech")),
    "m3_factor_scores": (factors, sql("bars fundamentals flows", f"{FACTORS} select * from factor")),
    "m4_ohlcv_fast_path": (
        lambda s, d: sc.technical_reversal(panel.bars(s, d)).select("asset_id", "d", sc.four(0.35 + 0.3 * F.col("score")).alias("composite")),
        sql("bars", f"{TECH} select asset_id, d, {r4('0.35::double + 0.3::double * score')} as composite from tech"),
    ),
    "m6_macro_phase": (lambda s, d: macro_months(s, d).select("date", "pmi", "slope", "phase"), sql("macro", f"with {PHASES.strip()} select date, pmi, slope, phase from ph")),
    "m5_context_weights": (
        lambda s, d: macro_months(s, d).withColumn("event", F.when(F.month("date") % 3 == 0, "trade_war").when(F.month("date") % 3 == 1, "rate_cut_cycle").otherwise("")).withColumn("w", sc.phase_weights(F.col("phase"), F.col("event"))).select("date", "phase", "event", *[sc.four(F.col(f"w.{n}")).alias(n) for n in ("financial", "flow", "technical")]),
        sql("macro", "with " + PHASES.strip() + ", ev as (select *, case when month(date) % 3 = 0 then 'trade_war' when month(date) % 3 = 1 then 'rate_cut_cycle' else '' end as event from ph), wt as (select *, " + ", ".join(f"({case('phase', sc.PHASE_WEIGHTS, 0, k)}) * ({case('event', sc.EVENT_FACTORS, 1.0, k)}) as w{k}" for k in range(3)) + f" from ev) select date, phase, event, {r4('w0 / (w0 + w1 + w2)')} as financial, {r4('w1 / (w0 + w1 + w2)')} as flow, {r4('w2 / (w0 + w1 + w2)')} as technical from wt"),
    ),
    "m7_heuristic_predictions": (predictions, sql("bars fundamentals flows macro news", f"{HEURISTIC} select asset_id, d, horizon, macro_phase, up, flat, down, label, {r4('greatest(0.0::double, least(1.0::double, 0.5::double + o[1] - o[2]))')} as confidence from hq")),
    "w27_importance_pruning": (
        lambda s, d: prune_plan(_importances(s, d)),
        sql("bars", f"with {IMPORTANCES}, r as (select model, importance, row_number() over w as rank, sum(importance) over (w rows between unbounded preceding and current row) as cum, sum(importance) over (partition by model) as total from imp window w as (partition by model order by importance desc, feature)), n as (select model, " + ", ".join(f"min(case when cum * 100 >= {x} * total then rank end) as need_{x}" for x in (80, 85, 90)) + ", count(*) as n from r group by model) select *, cast(least(n, greatest(20, least(25, need_80))) as integer) as keep from n"),
    ),
    "m18_trade_decisions": (lambda s, d: sc.decide(decisions_in(s, d)).select(*DECIDED), sql("bars", f"with {DECISIONS.strip()} select {', '.join(DECIDED)} from decided")),
    "m19_price_ladder": (
        lambda s, d: panel.table(s, d, "part").select("p_partkey", sc.ladder(F.col("p_size") * 17.3).alias("step_up")),
        "with x as (select p_partkey, p_size * 17.3::double as p from part) select p_partkey, case when p < 10 then ceil(p / 0.5::double) * 0.5::double when p < 50 then ceil(p / 1.0::double) * 1.0::double when p < 100 then ceil(p / 2.0::double) * 2.0::double when p < 500 then ceil(p / 5.0::double) * 5.0::double else ceil(p / 10.0::double) * 10.0::double end as step_up from x",
    ),
    "m24_macro_multiplier": (
        lambda s, d: macro_months(s, d).select("date", "phase", F.explode(F.array(*[F.lit(x) for x in (0.4, 0.55, 0.7, 0.9)])).alias("up")).withColumn("multiplier", sc.four(sc.macro_multiplier(F.col("phase"), F.col("up")))),
        sql("macro", "with " + PHASES.strip() + " select date, phase, up, " + r4("case phase " + " ".join(f"when '{p}' then {a}::double + {b}::double * greatest(0.0::double, up - {c}::double)" for p, (a, b, c) in sc.PHASE_MULTIPLIER.items()) + " else 1.0::double end") + " as multiplier from ph, (values (0.4::double), (0.55::double), (0.7::double), (0.9::double)) as u(up)"),
    ),
    "t4_top_candidates": (
        lambda s, d: sc.top_k(factors(s, d), 3, F.desc("bottom"), F.asc("asset_id")).select("d", "rank", "asset_id", "bottom"),
        sql("bars fundamentals flows", f"{FACTORS} select d, rank, asset_id, bottom from (select *, row_number() over (partition by d order by bottom desc, asset_id) as rank from factor) where rank <= 3"),
    ),
    "b1_bottom_candidates": (
        lambda s, d: sc.top_k(factors(s, d).where("bottom >= 0.6"), 5, F.desc("bottom"), F.asc("asset_id")).select("d", "rank", "asset_id", "bottom"),
        sql("bars fundamentals flows", f"{FACTORS} select d, rank, asset_id, bottom from (select *, row_number() over (partition by d order by bottom desc, asset_id) as rank from factor where bottom >= 0.6) where rank <= 5"),
    ),
    "b6_macro_rerank": (
        lambda s, d: _reranked(s, d),
        sql("bars fundamentals flows macro news", f"{HEURISTIC}, c1 as (select *, row_number() over (partition by d order by up desc, asset_id) as r1 from hq where horizon = 7), c2 as (select asset_id, d, up, macro_phase, {r4('up * (case macro_phase ' + ' '.join(f"when '{p}' then {a}::double + {b}::double * greatest(0.0::double, up - {c}::double)" for p, (a, b, c) in sc.PHASE_MULTIPLIER.items()) + ' else 1.0::double end)')} as value from c1 where r1 <= 6) select d, rank, asset_id, value from (select *, row_number() over (partition by d order by value desc, asset_id) as rank from c2) where rank <= 3"),
    ),
}


def _reranked(s, d):
    first = sc.top_k(predictions(s, d).where("horizon = 7"), 6, F.desc("up"), F.asc("asset_id"))
    value = sc.four(F.col("up") * sc.macro_multiplier(F.col("macro_phase"), F.col("up")))
    return sc.top_k(first.drop("rank").withColumn("value", value), 3, F.desc("value"), F.asc("asset_id")).select("d", "rank", "asset_id", "value")
