"""Flagship compositions: board, screeners, quality reports, backtests, features, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import mean, spread
from ..operators import backtest as bt
from ..operators import crosssection as cs
from ..operators import features as ft
from ..operators import indicators as ind
from ..operators import pointintime as pit
from ..operators import scoring as sc
from ..sources import panel
from ..sources.scratch import is_folder, scratch_path
from ..streaming import alerts
from . import lexicon
from .cte import sql
from .joins import CONTEXTS, MEMBERS, RET, contexts, with_label
from .relational import ASSET_WEEK, asset_week
from .scores import DAY_SENTIMENT, DECIDE, FACTORS, HEURISTIC, INPUTS, PHASES, case, day_sentiment, factors, macro_months, newest_days, predicted, predictions, scored
from .windows import RSI, W, lag, mean_sql, r4, spread_sql
from .windows import _ema as ema_sql


BOARD_COLUMNS = ("asset_id", "bar_d", "c", "symbol", "market", "composite", "bottom", "rsi", "middle", "upper", "lower", "sma_20", "sma_50", "macd", "rs_score", "up_3", "up_7", "up_30", "label_7", "sentiment_e4")


def board(s, d):
    """Each active asset's newest bar, factors, predictions by horizon, RSI, bands, averages, MACD, RS score and sentiment.

    All parts are one row an asset, from aggregates that keep the newest row.  Factors, RS scores and predictions are worked
    out together, for those days only that are an asset's newest: an asset without one of them on its newest day has none before.
    """
    bars = panel.shared_bars(s, d)
    bands = {"mid": mean("c", 20), "dev": spread("c", 20)}
    own = ind.rsi_columns(bars).withColumns(bands).select(
        "asset_id", F.col("d").alias("bar_d"), "c", sc.four(F.col("rsi")).alias("rsi"),
        sc.four(F.col("mid")).alias("middle"), sc.four(F.col("mid") + 2.0 * F.col("dev")).alias("upper"), sc.four(F.col("mid") - 2.0 * F.col("dev")).alias("lower"),
        *[sc.four(mean("c", n)).alias(f"sma_{n}") for n in (20, 50)],
    )
    out = pit.latest(own, "asset_id", "bar_d")
    out = out.join(panel.assets(s, d).where("active").select("asset_id", "symbol", "market"), "asset_id")
    x = scored(s, d, newest_days(s, d))
    for h in (3, 7, 30):
        x = predicted(x.drop("horizon").withColumn("horizon", F.lit(h))).withColumnsRenamed({"up": f"up_{h}", "label": f"label_{h}"})
    marks = pit.latest(x.select("asset_id", "d", "composite", "bottom", F.col("rs").alias("rs_score"), "up_3", "up_7", "up_30", "label_7"), "asset_id", "d").drop("d")
    week = pit.latest(asset_week(s, d), "asset_id", "published").select("asset_id", F.floor(F.col("x") * 10000 + 0.5).alias("sentiment_e4"))
    parts = [
        marks,
        ind.macd_latest(bars),
        week,
    ]
    for part in parts:
        out = out.join(part, "asset_id", "left")
    out = out.select(*BOARD_COLUMNS)
    return out.withColumn("suggested", F.coalesce((F.col("label_7") == "UP") & (F.col("bottom") >= 0.5), F.lit(False)))


def board_page(rows, *, market: str | None = None, search: str = "", suggested: bool | None = None, sort: str = "bottom", descending: bool = True, page: int = 1, size: int = 20):
    """A page of the board: filters, search in the symbol, any column as order, nulls last, ties by asset.

    Page and size are clamped to 1 and up and to 1..100; an unknown column sorts by ``bottom``.  The order is a top-k: no
    task ranks all rows.
    """
    page, size = max(1, page), min(100, max(1, size))
    if market is not None:
        rows = rows.where(F.col("market") == market)
    if search.strip():
        rows = rows.where(F.lower("symbol").contains(search.strip().lower()))
    if suggested is not None:
        rows = rows.where(F.col("suggested") == suggested)
    key = F.col(sort if sort in rows.columns else "bottom")
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "asset_id").offset((page - 1) * size).limit(size)


BOARD = f"""{HEURISTIC}, {ASSET_WEEK},
lb as (select asset_id, max(d) as bar_d, arg_max(c, d) as c from bars group by 1),
lf as (select asset_id, arg_max(composite, d) as composite, arg_max(bottom, d) as bottom from factor group by 1),
lr as (select asset_id, arg_max({r4('rsi')}, d) as rsi from rsi group by 1),
bb as (select asset_id, d, {mean_sql('c', 20)} as mid, {spread_sql('c', 20)} as dev from bars),
bl as (select asset_id, arg_max({r4('mid')}, d) as middle, arg_max({r4('mid + 2.0::double * dev')}, d) as upper, arg_max({r4('mid - 2.0::double * dev')}, d) as lower from bb where mid is not null group by 1),
sm as (select asset_id, d, {r4(mean_sql('c', 20))} as sma_20, {r4(mean_sql('c', 50))} as sma_50, row_number() over (partition by asset_id order by d desc) as r from bars),
cl as (select asset_id, list(cast(c as double) order by d) as x from bars group by asset_id),
mc as (select asset_id, {r4(ema_sql(12) + ' - ' + ema_sql(26))} as macd from cl),
b20 as (select asset_id, d, (c - lag(c, 20) over ({W})) * 1.0::double / lag(c, 20) over ({W}) as ret from bars),
br as (select asset_id, d, {r4('1 - cast(row_number() over (partition by d order by ret desc, asset_id) - 1 as double) / count(*) over (partition by d)')} as rs from b20 where ret is not null),
rl as (select asset_id, arg_max(rs, d) as rs_score from br group by 1),
lp as (select asset_id, arg_max(up, d) filter (where horizon = 7) as up_7, arg_max(label, d) filter (where horizon = 7) as label_7, arg_max(up, d) filter (where horizon = 3) as up_3, arg_max(up, d) filter (where horizon = 30) as up_30 from hq group by 1),
lw as (select asset_id, cast(floor(arg_max(x, published) * 10000 + 0.5) as bigint) as sentiment_e4 from aw group by 1),
board as (select asset_id, bar_d, lb.c, symbol, market, composite, bottom, rsi, middle, upper, lower, sma_20, sma_50, macd, rs_score, up_7, label_7, up_3, up_30, sentiment_e4, coalesce(label_7 = 'UP' and bottom >= 0.5, false) as suggested
  from lb join (select asset_id, symbol, market from assets where active) a using (asset_id) left join lf using (asset_id) left join lr using (asset_id) left join bl using (asset_id) left join (select asset_id, sma_20, sma_50 from sm where r = 1) s1 using (asset_id)
  left join mc using (asset_id) left join rl using (asset_id) left join lp using (asset_id) left join lw using (asset_id))"""


def bottom_candidates(s, d):
    """Newest factor rows re-weighted by the current macro phase, with the 7-day prediction."""
    days = newest_days(s, d)
    newest = pit.latest(factors(s, d, days), "asset_id", "d")
    months = panel.macro(s, d).where("pmi is not null")
    slope = F.col("pmi") - F.lag("pmi").over(Window.orderBy("date"))
    now = months.withColumn("phase", sc.phase(F.col("pmi"), slope, F.col("non_pmi"), F.col("cpi10") / 10.0)).agg(F.max_by("phase", "date").alias("phase"))
    x = newest.crossJoin(F.broadcast(now)).withColumn("w", sc.phase_weights(F.col("phase"), F.lit("")))
    value = sc.four(F.col("fundamental") * F.col("w.financial") + F.col("flow") * F.col("w.flow") + F.col("technical") * F.col("w.technical"))
    p = pit.latest(predictions(s, d, days).where("horizon = 7"), "asset_id", "d").select("asset_id", "up", "label")
    x = x.withColumn("value", value).join(p, "asset_id", "left")
    return x.orderBy(F.desc("value"), "asset_id").limit(20).select("asset_id", "d", "phase", "value", "up", "label")


def screeners(s, d):
    """High volume, breakout and trend reversal on each asset's newest bars."""
    bars = panel.bars(s, d)
    x = ind.rsi_columns(bars)
    w20 = Window.partitionBy("asset_id").orderBy("d").rowsBetween(-19, 0)
    x = x.withColumns({"n": F.count("c").over(w20), "vol": F.sum("v").over(w20), "high": F.max("h").over(w20), "rsi_1": F.lag("rsi").over(Window.partitionBy("asset_id").orderBy("d"))})
    x = pit.latest(x, "asset_id", "d")
    kinds = F.array(
        F.when(F.col("v") * F.col("n") * 2 >= F.col("vol") * 3, "HIGH_VOLUME"),
        F.when((F.col("n") == 20) & (F.col("c") * 100 >= 98 * F.col("high")), "BREAKOUT"),
        F.when((F.col("rsi_1") < 30) & (F.col("rsi") >= 30), "TREND_REVERSAL"),
        F.when(F.col("rsi") > 70, "OVERBOUGHT"),
        F.when(F.col("rsi") < 30, "OVERSOLD"),
    )
    return x.select("asset_id", "d", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("screen"))


def quality_report(s, d):
    """Issues by kind and severity: missing bars, missing fundamentals and flows, uncovered and overlapping contexts, stale macro."""
    bars = panel.shared_bars(s, d)
    days = panel.calendar(bars)
    keys = bars.select("asset_id", "d")
    held = pit.coverage(days, contexts(s, d))
    months = panel.fundamentals(s, d).select("asset_id", F.col("report_date").alias("m"))
    flows = panel.flows(s, d)
    parts = [
        ("missing_bar", "critical", pit.gaps(bars, days).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("n"))),
        ("missing_fundamental", "warning", keys.withColumn("m", F.trunc("d", "MM")).join(months, ["asset_id", "m"], "left_anti").agg(F.count(F.lit(1)).alias("n"))),
        ("missing_flow", "warning", keys.join(flows.select("asset_id", "d"), ["asset_id", "d"], "left_anti").agg(F.count(F.lit(1)).alias("n"))),
        ("null_pe", "warning", panel.fundamentals(s, d).agg(F.count_if(F.col("pe").isNull()).alias("n"))),
        ("neutral_roe", "info", panel.fundamentals(s, d).agg(F.count_if(F.col("roe_bp") == 0).alias("n"))),
        ("missing_context", "critical", held.agg(F.count_if(F.col("n") == 0).alias("n"))),
        ("overlapping_context", "critical", held.agg(F.count_if(F.col("n") > 1).alias("n"))),
        ("null_pmi", "critical", panel.macro(s, d).agg(F.count_if(F.col("pmi").isNull()).alias("n"))),
    ]
    out = None
    for kind, severity, frame in parts:
        row = frame.select(F.lit(kind).alias("issue"), F.lit(severity).alias("severity"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


QUALITY = f"""with {CONTEXTS.strip()}, cov as (select d, count(starts_at) as n from calendar left join ctx on starts_at <= d and (ends_at is null or ends_at >= d) group by d),
nn as (select d, row_number() over (order by d) as no from calendar), st as (select asset_id, no, lead(no) over (partition by asset_id order by no) as nx from bars join nn using (d))
select 'missing_bar' as issue, 'critical' as severity, cast(coalesce(sum(nx - no - 1), 0) as bigint) as n from st where nx - no > 1
union all select 'missing_fundamental', 'warning', count(*) from bars b where not exists (select 1 from fundamentals f where f.asset_id = b.asset_id and f.report_date = date_trunc('month', b.d))
union all select 'missing_flow', 'warning', count(*) from bars b where not exists (select 1 from flows f where f.asset_id = b.asset_id and f.d = b.d)
union all select 'null_pe', 'warning', count(*) filter (where pe is null) from fundamentals
union all select 'neutral_roe', 'info', count(*) filter (where roe_bp = 0) from fundamentals
union all select 'missing_context', 'critical', count(*) filter (where n = 0) from cov
union all select 'overlapping_context', 'critical', count(*) filter (where n > 1) from cov
union all select 'null_pmi', 'critical', count(*) filter (where pmi is null) from macro"""


def candidates(s, d, top: int = 3):
    """The best assets of each factor day with entry decisions and planned exits, for three runs of different slots."""
    bars = panel.shared_bars(s, d)
    picks = sc.top_k(factors(s, d), top, F.desc("bottom"), F.asc("asset_id")).select("d", "asset_id", "rank", "bottom")
    picks = _written(s, picks, "picks")  # a few rows a trading day: they and their assets are broadcast
    own = bars.join(F.broadcast(picks.select("asset_id").distinct()), "asset_id", "left_semi")
    x = pit.next_row(sc.decision_columns(own), 20, 20).where("exit_d is not null").join(F.broadcast(picks), ["asset_id", "d"])
    x = sc.decide(x.withColumns({"p": F.col("bottom"), "label": F.lit("UP"), "horizon": F.lit(7)}))
    runs = _runs(s)
    x = _written(s, x.select("asset_id", "d", "rank", "exit_d", "target", "stop"), "candidates")  # read for prices, picks and spans
    return x.crossJoin(F.broadcast(runs.select("run_id"))), bars, runs


def _written(s, rows, name):
    """``rows`` written to the scratch folder and read from there."""
    path = scratch_path(s, name)
    rows.write.parquet(path)
    return s.read.schema(rows.schema).parquet(path)


CANDIDATES = f"""{FACTORS}, {INPUTS.strip()},
pk as (select d, asset_id, bottom, row_number() over (partition by d order by bottom desc, asset_id) as rank from factor),
ex as (select b.asset_id, b.d, min(e.d) as exit_d from (select b.* from bars b join pk on pk.asset_id = b.asset_id and pk.d = b.d and pk.rank <= 3) b join bars e on e.asset_id = b.asset_id and e.d >= b.d + 20 and e.d <= b.d + 40 group by 1, 2),
dj as (select di.*, mid + 2 * dev as upper, mid - 2 * dev as lower, cast(di.c as double) as k, di.c * 1.01::double as up1, 7 as horizon, 'UP' as label, bottom as p, pk.rank, ex.exit_d
       from pk join di on di.asset_id = pk.asset_id and di.d = pk.d join ex on ex.asset_id = pk.asset_id and ex.d = pk.d where pk.rank <= 3), {DECIDE.strip()},
cand as materialized (select run_id, asset_id, d, rank, exit_d, target, stop from decided, (values (1), (2), (3)) as rn(run_id))"""


def _runs(s):
    return s.createDataFrame([(1, 2, 1.0, True), (2, 5, 0.5, True), (3, 10, 0.2, False)], "run_id long, slots long, fraction double, stop_target boolean")


def backtest(s, d):
    x, bars, runs = candidates(s, d)
    return bt.run(x, bars, runs)


def resumed_backtest(s, d):
    """The same runs, stopped after one chunk of days, and taken up again from the written state."""
    x, bars, runs = candidates(s, d)
    folder = scratch_path(s, "resumed")
    bt.run(x, bars, runs, chunk=900, folder=folder, most_chunks=1)
    return bt.run(x, bars, runs, chunk=900, folder=folder)


def backtest_curve(states):
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).alias(f"{c}_cents")
    return bt.curve(states).select("run_id", "d", cents("equity"), cents("cash"), "open_positions", "closed", "wins")


def backtest_trades(states):
    return bt.trades(states).select("run_id", "d", "side", "asset_id", *[F.floor(F.col(c) * 100 + 0.5).alias(f"{c}_e2") for c in ("qty", "price", "fee", "amount", "pnl")], "reason")


def backtest_metrics(states):
    return bt.metrics(bt.curve(states)).select("run_id", *[sc.four(F.col(c)).alias(c) for c in ("total_return", "annualized", "sharpe", "max_drawdown", "win_rate")], "trades")


def backtest_sql(select: str) -> str:
    """The run loop as a recursion over days: one row a run and day with its positions, sales and purchases."""
    sell, paid = f"(1 - {bt.SLIPPAGE_BPS}::double / 1e4::double)", f"(1 + {bt.FEE}::double)"
    at = f"(x.c * (1 + {bt.SLIPPAGE_BPS}::double / 1e4::double))"
    ends = "coalesce(px[x.asset_id] > 0 and ((stop_target and (px[x.asset_id] <= x.stop or px[x.asset_id] >= x.target)) or day >= x.exit_d), false)"
    body = f"""{CANDIDATES},
rr as (select * from (values (1, 2, 1.0::double, true), (2, 5, 0.5::double, true), (3, 10, 0.2::double, false)) as rn(run_id, slots, fraction, stop_target)),
able as (select * from cand where exit_d > d),
sp as (select distinct run_id, asset_id, cast(unnest(generate_series(d, exit_d, interval 1 day)) as date) as d from able),
pr as (select run_id, d, map_from_entries(list(struct_pack(a := asset_id, c := c::double))) as px from sp join bars using (asset_id, d) group by 1, 2),
pi as (select run_id, able.d, list(struct_pack(asset_id := asset_id, c := c::double, exit_d := exit_d, target := target::double, stop := stop::double) order by rank, asset_id) as picks from able left join bars using (asset_id, d) group by 1, 2),
tl as (select run_id, d, row_number() over (partition by run_id order by d) as no from calendar join (select run_id, min(d) as a, max(exit_d) as z from able group by 1) on d between a and z),
dy as materialized (select tl.run_id, no, tl.d as day, coalesce(px, map([]::bigint[], []::double[])) as px, coalesce(picks, []) as picks from tl left join pr on pr.run_id = tl.run_id and pr.d = tl.d left join pi on pi.run_id = tl.run_id and pi.d = tl.d),
st as (select run_id, slots, fraction, stop_target, 0::bigint as no, date '1900-01-01' as day, {bt.CAPITAL}::double as cash, {bt.CAPITAL}::double as equity,
              []::struct(asset_id bigint, qty double, cost double, buy double, exit_d date, target double, stop double)[] as held,
              []::struct(asset_id bigint, qty double, c double, cost double, reason varchar)[] as sold,
              []::struct(asset_id bigint, qty double, cost double, buy double, exit_d date, target double, stop double)[] as bought from rr
       union all
       select run_id, slots, fraction, stop_target, no, day, cash, cash + coalesce(list_sum(list_transform(held, lambda x: x.qty * coalesce(px[x.asset_id], x.buy))), 0.0::double), held, sold, bought
       from (select *, list_concat(kept, bought) as held, cash1 - len(bought) * coalesce(part, 0.0::double) * {paid} as cash
             from (select *, list_transform(list_filter(chosen, lambda x: coalesce(x.c > 0, false) and part is not null), lambda x: struct_pack(asset_id := x.asset_id, qty := part / {at}, cost := part * {paid}, buy := {at}, exit_d := x.exit_d, target := x.target, stop := x.stop)) as bought
                   from (select *, case when len(chosen) > 0 and cash1 >= {bt.LEAST_CASH}::double then least(cash1, {bt.CAPITAL}::double * fraction) / len(chosen) / {paid} end as part
                         from (select *, cash0 + coalesce(list_sum(list_transform(sold, lambda x: x.qty * x.c * {sell} * (1 - {bt.FEE}::double))), 0.0::double) as cash1, picks[1:greatest(slots - len(kept), 0)] as chosen
                               from (select st.run_id, slots, fraction, stop_target, y.no, y.day, px, picks, cash as cash0, list_filter(held, lambda x: not {ends.replace('day >=', 'y.day >=')}) as kept,
                                            list_transform(list_filter(held, lambda x: {ends.replace('day >=', 'y.day >=')}), lambda x: struct_pack(asset_id := x.asset_id, qty := x.qty, c := px[x.asset_id], cost := x.cost,
                                              reason := case when stop_target and px[x.asset_id] <= x.stop then 'STOP_LOSS' when stop_target and px[x.asset_id] >= x.target then 'TARGET_PRICE' else 'SCHEDULED' end)) as sold
                                     from st join dy y on y.run_id = st.run_id and y.no = st.no + 1)))))),
curve as (select run_id, day as d, equity, cash, len(held)::bigint as open_positions, len(sold)::bigint as closed, len(list_filter(sold, lambda x: x.qty * x.c * {sell} * (1 - {bt.FEE}::double) - x.cost > 0))::bigint as wins from st where no > 0)
{select}"""
    return sql("bars calendar fundamentals flows macro news", body).replace("with ", "with recursive ", 1)


CURVE = backtest_sql("select run_id, d, cast(floor(equity * 100 + 0.5) as bigint) as equity_cents, cast(floor(cash * 100 + 0.5) as bigint) as cash_cents, open_positions, closed, wins from curve")
_E2 = lambda name, x: f"cast(floor({x} * 100 + 0.5) as bigint) as {name}_e2"
_SOLD = f"x.qty * x.c * (1 - {bt.SLIPPAGE_BPS}::double / 1e4::double)"
TRADES = backtest_sql(
    f"select run_id, day as d, 'SELL' as side, x.asset_id as asset_id, {_E2('qty', 'x.qty')}, {_E2('price', f'x.c * (1 - {bt.SLIPPAGE_BPS}::double / 1e4::double)')}, {_E2('fee', f'{_SOLD} * {bt.FEE}::double')}, {_E2('amount', _SOLD)}, "
    f"{_E2('pnl', f'({_SOLD} * (1 - {bt.FEE}::double) - x.cost)')}, x.reason as reason from (select run_id, day, unnest(sold) as x from st) union all "
    f"select run_id, day, 'BUY', x.asset_id, {_E2('qty', 'x.qty')}, {_E2('price', 'x.buy')}, {_E2('fee', f'x.cost / (1 + {bt.FEE}::double) * {bt.FEE}::double')}, {_E2('amount', f'x.cost / (1 + {bt.FEE}::double)')}, 0, null from (select run_id, day, unnest(bought) as x from st)"
)
METRICS = backtest_sql(
    f""", ch as (select *, equity / nullif(lag(equity) over w, 0) - 1 as r, 1 - equity / max(equity) over w as fall from curve window w as (partition by run_id order by d)),
me as (select run_id, arg_max(equity, d) / {bt.CAPITAL}::double - 1 as total, greatest(1, max(d) - min(d)) as days, avg(r) as mean, stddev_pop(r) as dev, count(r) as n, max(fall) as fall, cast(sum(closed) as bigint) as trades, cast(sum(wins) as bigint) as wins from ch group by run_id)
select run_id, {r4('total')} as total_return, {r4('least(greatest(case when 1 + total <= 0 then -1.0::double else pow(1 + total, 365.0::double / days) - 1 end, -1.0::double), 10.0::double)')} as annualized,
       {r4('case when n >= 2 and dev > 0 then least(greatest(mean / dev * sqrt(252.0::double), -10.0::double), 10.0::double) else 0.0::double end')} as sharpe, {r4('least(greatest(fall, 0.0::double), 1.0::double)')} as max_drawdown,
       {r4('case when trades > 0 then wins / trades::double else 0.0::double end')} as win_rate, trades from me"""
)


def comparison(s, d):
    """The market's total and one of equal weights, both from the same base, with drawdowns."""
    bars = panel.bars(s, d)
    total = bars.groupBy("d").agg(F.sum("c").alias("value")).select(F.lit("market").alias("series"), "d", "value")
    volume = bars.groupBy("d").agg(F.sum("v").alias("value")).select(F.lit("volume").alias("series"), "d", "value")
    x = bt.rebased(total.unionByName(volume), "value", 100000.0)
    peak = F.max("value").over(Window.partitionBy("series").orderBy("d"))
    return x.select("series", "d", sc.four(F.col("value")).alias("value"), sc.four(F.col("value") / peak - 1).alias("drawdown"))


def feature_matrix(s, d):
    bars = panel.shared_bars(s, d)
    daily = day_sentiment(s, d, panel.calendar(bars)).withColumnRenamed("d", "published")
    known = macro_months(s, d).select("date", "phase")
    macro = panel.macro(s, d).join(known, "date", "left").withColumn("phase", F.last("phase", True).over(Window.orderBy("date")))  # one row a month
    return ft.matrix(bars, cs.rs_score(bars), factors(s, d), macro, daily)


MATRIX_ROWS = f"""{FACTORS}, {PHASES.strip()}, {DAY_SENTIMENT},
m20 as (select asset_id, d, (c - lag(c, 20) over ({W})) * 1.0::double / lag(c, 20) over ({W}) as ret from bars),
mr as (select asset_id, d, {r4('1 - cast(row_number() over (partition by d order by ret desc, asset_id) - 1 as double) / count(*) over (partition by d)')} as rs_score from m20 where ret is not null),
mb as (select asset_id, d, coalesce(cast(floor(cast((c - {lag('c', 1)}) * 10000 as double) / {lag('c', 1)} + 0.5) as bigint), 0) as bp from bars),
mv as (select asset_id, d, {r4('case when count(bp) over w >= 2 then sqrt(cast(count(bp) over w * sum(bp * bp) over w - sum(bp) over w * sum(bp) over w as double)) / cast(count(bp) over w as double) else 0.0::double end')} as volatility_bp from mb window w as ({W} rows between 4 preceding and current row)),
mx as materialized (select asset_id, d, c, h, l, v, {r4('rsi')} as rsi, {', '.join(f"coalesce({r4(f'(c - {lag("c", n)}) * 1.0::double / {lag("c", n)}')}, 0.0::double) as ret_{n}" for n in (3, 5, 10))},
       {', '.join(f"{r4(f'coalesce({lag("rsi", k)}, rsi)')} as rsi_lag_{k}, {r4(f'rsi - coalesce({lag("rsi", k)}, rsi)')} as rsi_delta_{k}" for k in (3, 5, 10))},
       {', '.join(r4(f"coalesce(cast(v * count(v) over w{n} as double) / nullif(cast(sum(v) over w{n} as double), 0), 1.0::double)") + f" as rel_volume_{n}" for n in (5, 20))}
       from rsi window w5 as ({W} rows between 4 preceding and current row), w20 as ({W} rows between 19 preceding and current row)),
mf as (select mx.asset_id, mx.d, {', '.join(f"x.{n}" for n in ft.FACTORS)} from mx asof join factor x on mx.asset_id = x.asset_id and mx.d >= x.d),
mm as (select macro.*, last_value(ph.phase ignore nulls) over (order by macro.date) as phase from macro left join ph using (date)),
my as (select mx.*, volatility_bp, coalesce(rs_score, 0.5::double) as rs_score, {', '.join(f"coalesce(mf.{n}, 0.5::double) as {n}" for n in ft.FACTORS)}, 0.5::double as northbound,
              coalesce(da.sentiment, 0.0::double) as sentiment, coalesce(cast(mm.pmi as double), 50.0::double) as pmi, coalesce(cast(mm.non_pmi as double), 50.0::double) as non_pmi,
              coalesce((mm.y10 - mm.y2) / 100.0::double, 0.0::double) as curve, {case('mm.phase', ft.PHASE_CODE, 1.0)} as phase_code
       from mx join mv using (asset_id, d) left join mr using (asset_id, d) left join da on da.d = mx.d left join mm on mm.date = date_trunc('month', mx.d)
       left join mf on mf.asset_id = mx.asset_id and mf.d = mx.d),
mz as (select *, {', '.join(r4(f"{n} - coalesce({lag(n, k)}, {n})") + f" as {to}_{k}" for n, to in (('ret_5', 'ret_5_delta'), ('rs_score', 'rs_delta')) for k in ft.LAGS)},
              {r4('cast(sum(cast(floor(sentiment * 10000 + 0.5) as bigint)) over w20 as double) / (count(*) over w20 * 10000.0::double)')} as sentiment_20
       from my window w20 as ({W} rows between 19 preceding and current row)),
matrix as (select *, {', '.join(r4(f'{a} * {b}') + f' as {n}' for n, (a, b) in ft.INTERACTIONS.items())} from mz)"""


def forest(s, d):
    """Labels at seven days against the matrix: fitted before 1999, scored from then on."""
    features = ["rsi", "ret_3", "ret_5", "ret_10", "rel_volume_5", "volatility_bp", "rs_score", "composite", "pmi", "curve"]
    rows = with_label(feature_matrix(s, d)).where("label is not null").select("asset_id", "d", *features, "label")
    path = scratch_path(s, "forest")  # training reads it several times: the matrix is worked out once
    rows.write.parquet(path)
    rows = s.read.schema(rows.schema).parquet(path)
    model = ft.fit_forest(rows.where("d < '1999-01-01'"), features)
    return ft.accuracy(model.transform(rows.where("d >= '1999-01-01'")))


def alert_stream(s, d):
    """The events as a stream from files, through the stateful operator, run until all are read."""
    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    reader = s.readStream.schema(schema)
    if is_folder(s, path):
        stream = reader.parquet(path)
    else:  # a stream reads folders only
        folder, file = path.rsplit("/", 1)
        stream = reader.option("pathGlobFilter", file).parquet(folder)
    out = alerts.fired_stream(stream, 95.0)
    to = scratch_path(s, "alerts")
    query = out.writeStream.format("parquet").option("path", to).option("checkpointLocation", f"{to}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(out.schema).parquet(to)


def curve_points(s, d):
    """The month's newest yields: per date the best curve type ('0', '1', other), then the newest date."""
    o = panel.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 3).cast("string").alias("curve_type"), (F.col("o_orderkey") % 500).alias("y"))
    best = o.groupBy("date", F.when(F.col("curve_type") == "0", 0).when(F.col("curve_type") == "1", 1).otherwise(2).alias("pref")).agg(F.max("y").alias("y"))
    one = best.groupBy("date").agg(F.min_by("y", "pref").alias("y"))
    return one.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"), F.max_by("y", "date").alias("y"))


ALERTS = f"with recursive e as (select event_type, event_id, epoch(ts)::bigint as t, row_number() over (partition by event_type order by ts, event_id) as r from events where value > 95), f as (select event_type, event_id, t, r from e where r = 1 union all select e.event_type, e.event_id, e.t, e.r from f join e on e.event_type = f.event_type and e.r = (select min(x.r) from e x where x.event_type = f.event_type and x.t >= f.t + {alerts.COOLDOWN_S} and x.r > f.r)) select event_type, event_id from f"

QUERIES = {
    "qa_stock_board": (board, sql("bars assets fundamentals flows macro news", f"{BOARD} select * from board")),
    "qa_board_page": (
        lambda s, d: board_page(board(s, d), search="00", sort="rs_score", page=2, size=7),
        sql("bars assets fundamentals flows macro news", f"{BOARD} select * from board where contains(lower(symbol), '00') order by rs_score desc nulls last, asset_id limit 7 offset 7"),
    ),
    "qb_bottom_candidates": (
        bottom_candidates,
        sql(
            "bars fundamentals flows macro news",
            f"{HEURISTIC}, cur as (select arg_max(phase, date) as phase from ph), nf as (select asset_id, max(d) as d, arg_max(fundamental, d) as fundamental, arg_max(flow, d) as flow, arg_max(technical, d) as technical from factor group by 1), "
            f"wx as (select nf.*, phase, {', '.join(f'({case("phase", sc.PHASE_WEIGHTS, 0, k)}) as w{k}' for k in range(3))} from nf, cur), "
            "hl as (select asset_id, arg_max(up, d) as up, arg_max(label, d) as label from hq where horizon = 7 group by 1) "
            f"select asset_id, d, phase, {r4('fundamental * (w0 / (w0 + w1 + w2)) + flow * (w1 / (w0 + w1 + w2)) + technical * (w2 / (w0 + w1 + w2))')} as value, up, label from wx left join hl using (asset_id) order by value desc, asset_id limit 20",
        ),
    ),
    "qc_screeners": (
        screeners,
        sql(
            "bars",
            f"with {RSI.strip()}, x as (select *, count(c) over w as n, sum(v) over w as vol, max(h) over w as high, lag(rsi) over ({W}) as rsi_1, row_number() over (partition by asset_id order by d desc) as r from rsi window w as ({W} rows between 19 preceding and current row)), y as (select * from x where r = 1) "
            "select asset_id, d, 'HIGH_VOLUME' as screen from y where v * n * 2 >= vol * 3 union all select asset_id, d, 'BREAKOUT' from y where n = 20 and c * 100 >= 98 * high union all select asset_id, d, 'TREND_REVERSAL' from y where rsi_1 < 30 and rsi >= 30 union all select asset_id, d, 'OVERBOUGHT' from y where rsi > 70 union all select asset_id, d, 'OVERSOLD' from y where rsi < 30",
        ),
    ),
    "qd_indicator_compare": (
        lambda s, d: _compare(s, d),
        sql("bars", f"with {RSI.strip()}, x as (select asset_id, d, cast(floor(rsi + 0.5) as bigint) as y from rsi where d between '1998-01-01' and '1998-06-30') select asset_id, count(*) as n, array_to_string(list(y order by d), ',') as series from x group by 1"),
    ),
    "qe_latest_fibonacci": (
        lambda s, d: pit.latest(ind.fibonacci(panel.bars(s, d)), "asset_id", "d"),
        sql("bars", f"with a as (select asset_id, d, row_number() over ({W}) as row, min(l) over w as lo, max(h) over w as hi from bars window w as ({W} rows between 59 preceding and current row)), b as (select *, row_number() over (partition by asset_id order by d desc) as r from a where row >= 60 and hi > lo) select asset_id, d, {', '.join(f'{r4(f"hi - (hi - lo) * {x}::double")} as fib_{int(x * 1000)}' for x in ind.FIB_LEVELS)} from b where r = 1"),
    ),
    "qg_quality_report": (quality_report, sql("bars calendar fundamentals flows macro", QUALITY)),
    "qj_list_dates": (
        lambda s, d: _list_dates(s, d),
        sql("bars assets", "select a.asset_id, f.first_d as list_date from assets a join (select asset_id, min(d) as first_d from bars group by 1) f using (asset_id) where first_d is distinct from date '1995-01-02' + cast(a.asset_id % 3 as integer)"),
    ),
    "qk_context_history": (
        lambda s, d: _context_history(s, d),
        sql("macro", f"with {PHASES.strip()} select date as starts_at, lead(date) over (order by date) - 1 as ends_at, phase, lead(date) over (order by date) is null as is_active from ph"),
    ),
    "m10_feature_matrix": (feature_matrix, sql("bars fundamentals flows macro news", f"{MATRIX_ROWS} select * from matrix")),
    "m13_forest_accuracy": (forest, None),
    "m26_curve_points": (
        curve_points,
        "with o as (select cast(o_orderdate as date) as date, case when o_custkey % 3 < 2 then o_custkey % 3 else 2 end as pref, max(o_orderkey % 500) as y from orders group by 1, 2), one as (select date, arg_min(y, pref) as y from o group by 1) select cast(date_trunc('month', date) as date) as month, max(date) as date, arg_max(y, date) as y from one group by 1",
    ),
    "m27_fx_normalized": (
        lambda s, d: _fx(s, d),
        "with x as (select c_custkey, c_custkey * 7 % 2000 + 1 as quote from customer) select c_custkey, quote, case when quote >= 1000 then floor(quote / 100.0::double * 10000 + 0.5) / 10000 else floor(1.0::double / quote * 10000 + 0.5) / 10000 end as rate from x",
    ),
    "m28_month_last_value": (
        lambda s, d: panel.bars(s, d).groupBy("asset_id", F.trunc("d", "MM").alias("month")).agg(F.max("d").alias("last_d"), F.max_by("c", "d").alias("last_c")),
        sql("bars", "select asset_id, cast(date_trunc('month', d) as date) as month, max(d) as last_d, arg_max(c, d) as last_c from bars group by 1, 2"),
    ),
    "b3_combined_candidates": (
        lambda s, d: _combined(s, d),
        sql("bars fundamentals flows macro news", f"{HEURISTIC}, p as (select asset_id, d, up as a from hq where horizon = 7), q as (select asset_id, d, bottom as b from factor where bottom >= 0.45), j as (select coalesce(p.asset_id, q.asset_id) as asset_id, coalesce(p.d, q.d) as d, {r4('(coalesce(a, 0.0::double) + coalesce(b, 0.0::double)) / ((a is not null)::int + (b is not null)::int)')} as value from p full join q on p.asset_id = q.asset_id and p.d = q.d) select d, rank, asset_id, value from (select *, row_number() over (partition by d order by value desc, asset_id) as rank from j where value >= 0.4) where rank <= 4"),
    ),
    "b7_backtest_trades": (lambda s, d: backtest_trades(backtest(s, d)), TRADES),
    "b10_backtest_runs": (lambda s, d: backtest_curve(backtest(s, d)), CURVE),
    "b11_backtest_metrics": (lambda s, d: backtest_metrics(backtest(s, d)), METRICS),
    "r8_resumed_backtest": (lambda s, d: backtest_curve(resumed_backtest(s, d)), CURVE),
    "b12_benchmark_coverage": (
        lambda s, d: _covered(s, d),
        sql("bars assets calendar membership fundamentals", f"with {MEMBERS.strip()}, {RET.strip()}, n as (select count(*) as days, count(ret.d) as covered from calendar left join ret using (d)) select days, covered, case when days = covered then 'point_in_time' else 'equal_weight' end as benchmark from n"),
    ),
    "b14_comparison": (
        comparison,
        sql("bars", f"with x as (select 'market' as series, d, sum(c) as v from bars group by d union all select 'volume', d, sum(v) from bars group by d), y as (select series, d, v * 100000.0::double / first_value(v) over (partition by series order by d) as v from x) select series, d, {r4('v')} as value, {r4('v / max(v) over (partition by series order by d) - 1')} as drawdown from y"),
    ),
    "b16_validation_windows": (
        lambda s, d: bt.windows("1996-01-01", "2000-12-31", 180, 90, s).crossJoin(F.broadcast(s.createDataFrame([("heuristic",), ("boosted",), ("lstm",)], "source string"))),
        "select cast(a as date) as start_d, least(cast(a as date) + 179, date '2000-12-31') as end_d, source from unnest(generate_series(timestamp '1996-01-01', timestamp '2000-12-31', interval 90 day)) as t(a), (values ('heuristic'), ('boosted'), ('lstm')) as s(source)",
    ),
    "r1_hourly_counts": (
        lambda s, d: alerts.hourly(panel.table(s, d, "events").withColumn("value", F.floor(F.col("value") * 100 + 0.5).cast("long"))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")),
        "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, cast(sum(cast(floor(value * 100 + 0.5) as bigint)) as bigint) as total from events group by 1, 2",
    ),
    "r2_alerts_batch": (
        lambda s, d: alerts.fired(panel.table(s, d, "events"), 95.0).select("event_type", "event_id"),
        ALERTS,
    ),
    "r2_alerts_stream": (lambda s, d: alert_stream(s, d).select("event_type", "event_id"), ALERTS),
}


def _compare(s, d):
    x = ind.rsi_columns(panel.bars(s, d)).where("d between '1998-01-01' and '1998-06-30'")
    rows = F.array_sort(F.collect_list(F.struct("d", F.floor(F.col("rsi") + 0.5).alias("y"))))
    return x.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda r: r["y"].cast("string")), ",").alias("series"))


def _list_dates(s, d):
    first = panel.bars(s, d).groupBy("asset_id").agg(F.min("d").alias("list_date"))
    known = panel.assets(s, d).select("asset_id", F.date_add(F.lit("1995-01-02").cast("date"), (F.col("asset_id") % 3).cast("int")).alias("known"))
    return known.join(first, "asset_id").where(~F.col("known").eqNullSafe(F.col("list_date"))).select("asset_id", "list_date")


def _context_history(s, d):
    m = panel.macro(s, d).where("pmi is not null")
    order = Window.orderBy("date")  # one row a month
    m = m.withColumn("slope", F.col("pmi") - F.lag("pmi").over(order))
    m = m.withColumn("phase", sc.phase(F.col("pmi"), F.col("slope"), F.col("non_pmi"), F.col("cpi10") / 10.0))
    following = F.lead("date").over(order)
    return m.select(F.col("date").alias("starts_at"), F.date_sub(following, 1).alias("ends_at"), "phase", following.isNull().alias("is_active"))


def _fx(s, d):
    x = panel.table(s, d, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 2000 + 1).alias("quote"))
    return x.withColumn("rate", F.when(F.col("quote") >= 1000, sc.four(F.col("quote") / 100.0)).otherwise(sc.four(1.0 / F.col("quote"))))


def _combined(s, d):
    x = predicted(scored(s, d).withColumn("horizon", F.lit(7)))
    both = x.select("asset_id", "d", F.col("up").alias("a"), F.when(F.col("bottom") >= 0.45, F.col("bottom")).alias("b"))
    known = F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")
    value = sc.four(F.when(known > 0, (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / known))
    return sc.top_k(both.withColumn("value", value).where("value >= 0.4"), 4, F.desc("value"), F.asc("asset_id")).select("d", "rank", "asset_id", "value")


def _covered(s, d):
    """The point-in-time value is the benchmark only if it covers every trading day, else the equal-weight mean."""
    bars = panel.shared_bars(s, d)
    nav = cs.weighted_returns(bars, panel.membership(panel.calendar(bars), panel.assets(s, d)), panel.fundamentals(s, d)).select("d", F.lit(1).alias("has"))
    x = panel.calendar(bars).join(nav, "d", "left").agg(F.count(F.lit(1)).alias("days"), F.count("has").alias("covered"))
    return x.withColumn("benchmark", F.when(F.col("days") == F.col("covered"), "point_in_time").otherwise("equal_weight"))
