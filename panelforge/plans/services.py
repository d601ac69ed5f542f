"""Queries behind lists and services: current values, registries, batch predictions, exports, incremental continuation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import crosssection as cs
from ..operators import indicators as ind
from ..operators import pointintime as pit
from ..operators import scoring as sc
from ..operators import signals as sig
from ..sources import panel, sinks
from . import lexicon
from .composites import CANDIDATES, candidates
from .cte import sql
from .joins import CONTEXTS, MEMBERS, _labels, contexts
from .relational import SENT, TAGS, linked
from .scores import DECIDE, DECISIONS, FACTORS, HEURISTIC, INPUTS, PHASES, decisions_in, factors, heuristics_in, newest_days, predictions
from . import windows
from .windows import RSI, W, adx_sql, r4


def e4(x: str) -> str:
    return f"cast(floor(({x}) * 10000 + 0.5) as bigint)"


def _e4(x):
    return F.floor(x * 10000 + 0.5)


def _articles(s, d):
    return panel.news(s, d).select("article_id", "published", "source", "text")


def _sent_micro(s, d):
    return lexicon.sentiment(_articles(s, d)).select("article_id", "published", "source", F.floor(F.col("sentiment") * 1000000 + 0.5).cast("long").alias("m"))


def _registry(s, d):
    """Model versions from parts: family, version, trained day, status."""
    return panel.table(s, d, "part").select(
        (F.col("p_partkey") % 3).alias("family"), F.col("p_partkey").alias("version"), (F.col("p_size").cast("long") * 7 % 400).alias("trained"),
        F.when(F.col("p_partkey") % 4 == 0, "FAILED").otherwise("READY").alias("status"),
    )


REGISTRY = "reg as (select p_partkey % 3 as family, p_partkey as version, cast(p_size as bigint) * 7 % 400 as trained, case when p_partkey % 4 = 0 then 'FAILED' else 'READY' end as status from part)"


def _runs(s, d):
    """Backtest runs from orders: id, strategy, return in basis points."""
    o = panel.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("status"), (F.floor(F.col("o_totalprice") + 0.5).cast("long") % 2000 - 1000).alias("ret_bp"))


RUNS = "runs as (select o_orderkey as run_id, o_orderpriority as strategy, o_orderstatus as status, cast(floor(o_totalprice + 0.5) as bigint) % 2000 - 1000 as ret_bp from orders)"


def _equity(s, d):
    """The market's total close by day, in whole ticks."""
    return panel.bars(s, d).groupBy("d").agg(F.sum("c").alias("equity"))


def _continued(s, d):
    """NAV from a stored value: seeded at the last day before 1999 and continued with that day's returns left out."""
    r = cs.equal_weight(panel.bars(s, d)).select("d", "ret_bp")
    before, after = r.where("d < '1999-01-01'"), r.where("d >= '1999-01-01'")
    seed = before.agg((F.exp(F.sum(F.log1p(F.col("ret_bp") / 10000.0))) * 100000.0).alias("seed"))
    grown = F.exp(F.sum(F.log1p(F.col("ret_bp") / 10000.0)).over(Window.orderBy("d")))  # one row a day
    return after.crossJoin(F.broadcast(seed)).select("d", F.round(F.col("seed") * grown, 2).alias("nav"))


EQ = f"eq as (select d, cast(sum(bp) as double) / cast(count(bp) as double) as ret_bp from (select d, cast(floor((c - lag(c) over ({W})) * 10000.0::double / lag(c) over ({W}) + 0.5) as bigint) as bp from bars) where bp is not null group by d)"


def _eligible(s, d):
    """Assets that trade on a day and are members of an index then."""
    bars = panel.bars(s, d)
    days = panel.calendar(bars)
    on = pit.members_on(days, panel.membership(days, panel.assets(s, d))).select("d", "asset_id")
    return bars.select("d", "asset_id").join(on, ["d", "asset_id"], "left_semi")


def _batch(s, d):
    """Newest heuristic prediction of every asset and horizon with its trade decision: the batch that is stored."""
    # an asset without a prediction on its newest day has none before
    rows = sc.heuristic(heuristics_in(s, d, newest_days(s, d), "c", *sc.DECISION, more=sc.decision_columns))
    x = rows.groupBy("asset_id", "horizon").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("asset_id", "horizon")]), "d").alias("r")).select("asset_id", "horizon", "r.*")
    return sc.decide(x.withColumn("p", F.col("up"))).select("asset_id", "d", "horizon", "label", "up", "target", "stop", "reward_risk", "trade_score", "suggested")


def _upsert_versions(s, d):
    """Articles replayed three times with a version each: the last version of a url stays."""
    n = panel.news(s, d).select("url", "source", "article_id")
    replay = n.select("url", F.concat_ws("-", "source", F.lit("v1")).alias("source"), F.lit(1).alias("version"))
    for v, cond in ((2, "length(url) % 2 = 0"), (3, "url like '%7'")):
        replay = replay.unionByName(n.where(cond).select("url", F.concat_ws("-", "source", F.lit(f"v{v}")).alias("source"), F.lit(v).alias("version")))
    return replay.groupBy("url").agg(F.max("version").alias("version"), F.max_by("source", "version").alias("source"))


def _scaled(s, d):
    """Mean and population deviation of features over the rows before 1999, as a scaler is fitted; squares add up to decimals."""
    x = panel.bars(s, d).where("d < '1999-01-01'")
    cols = []
    for c in ("c", "v"):
        wide = F.col(c).cast("decimal(19,0)")
        n, t, q = F.count(c).cast("decimal(19,0)"), F.sum(wide), F.sum((wide * wide).cast("decimal(28,0)"))
        cols += [_e4(t.cast("double") / n.cast("double")).alias(f"{c}_mean"), _e4(F.sqrt((n * q - t * t).cast("double")) / n.cast("double")).alias(f"{c}_dev")]
    return x.agg(*cols)


def _article_assets(s, d):
    """Market and linked means: an article counts once by itself and once for each linked asset."""
    one = _sent_micro(s, d)
    both = one.select("m").unionByName(one.join(linked(s, d), "article_id").select("m"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("m") / (F.count(F.lit(1)) * 100.0) + 0.5).alias("mean_e4"))


QUERIES = {
    "s5_price_map": (lambda s, d: panel.bars(s, d).select("asset_id", "d", F.col("c").alias("price")), sql("bars", "select asset_id, d, c as price from bars")),
    "s8_index_daily": (
        lambda s, d: _index_daily(s, d),
        sql("bars assets", "select t as index_code, d, cast(sum(c) as bigint) as level, count(*) as n from bars join (select asset_id, unnest(tags) as t from assets) x using (asset_id) group by 1, 2"),
    ),
    "s10_daily_basic": (
        lambda s, d: _daily_basic(s, d),
        "select o_orderkey as asset_id, cast(o_orderdate as date) as d, case when o_custkey % 7 <> 0 then cast(o_custkey % 90 as double) end as pe from orders where o_orderkey % 13 <> 0",
    ),
    "s12_flow_last_wins": (
        lambda s, d: panel.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id"), F.to_date("l_shipdate").alias("d")).agg(F.max(F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))).alias("r")).select("asset_id", "d", F.col("r.l_orderkey").alias("order_key"), F.col("r.q").alias("q")),
        "select l_suppkey as asset_id, cast(l_shipdate as date) as d, max(l_orderkey) as order_key, arg_max(cast(l_quantity as bigint), (l_orderkey, l_linenumber, cast(l_quantity as bigint))) as q from lineitem group by 1, 2",
    ),
    "p3_indicator_range": (
        lambda s, d: ind.rsi_columns(panel.bars(s, d)).where("d between '1998-01-01' and '1998-03-31' and rsi > 60").select("asset_id", "d", _e4(F.col("rsi")).alias("rsi_e4")),
        sql("bars", f"with {RSI.strip()} select asset_id, d, {e4('rsi')} as rsi_e4 from rsi where d between '1998-01-01' and '1998-03-31' and rsi > 60"),
    ),
    "p5_top_sentiment": (
        lambda s, d: _sent_micro(s, d).orderBy(F.desc("m"), "article_id").limit(50).select("article_id", "m"),
        sql("news", f"with {SENT.strip()} select article_id, cast(floor(s * 1000000 + 0.5) as bigint) as m from sent order by m desc, article_id limit 50"),
    ),
    "p6_top_concepts": (
        lambda s, d: _top_concepts(s, d),
        sql("news", f"with {TAGS}, h as (select unnest(tags) as tag, published from tg), l as (select max(published) as d from h) select tag, count(*) as heat from h, l where published = l.d group by tag order by heat desc, tag limit 20"),
    ),
    "p7_current_context": (
        lambda s, d: contexts(s, d).where("ends_at is null").orderBy(F.desc("starts_at")).limit(1),
        sql("macro", f"with {CONTEXTS.strip()} select starts_at, label, ends_at from ctx where ends_at is null order by starts_at desc limit 1"),
    ),
    "p9_eligible_assets": (_eligible, sql("bars assets calendar membership", f"with {MEMBERS.strip()} select b.d, b.asset_id from bars b join on_day o on o.d = b.d and o.asset_id = b.asset_id")),
    "p11_visible_templates": (
        lambda s, d: panel.table(s, d, "customer").where("c_nationkey = 3 or c_acctbal > 5000").select("c_custkey").distinct(),
        "select distinct c_custkey from customer where c_nationkey = 3 or c_acctbal > 5000",
    ),
    "p16_prediction_list": (
        lambda s, d: predictions(s, d).where("horizon = 30 and up >= 0.35").select("asset_id", "d", "up", "label"),
        sql("bars fundamentals flows macro news", f"{HEURISTIC} select asset_id, d, up, label from hq where horizon = 30 and up >= 0.35"),
    ),
    "p17_run_list": (lambda s, d: _runs(s, d).where("status = 'F' and ret_bp > 0").select("run_id", "strategy", "ret_bp"), f"with {RUNS} select run_id, strategy, ret_bp from runs where status = 'F' and ret_bp > 0"),
    "j2_features_labels": (
        lambda s, d: _features_labels(s, d),
        sql("bars", f"with {RSI.strip()}, x as (select b.asset_id, b.d, b.c, min(e.d) as exit_d from bars b join bars e on e.asset_id = b.asset_id and e.d >= b.d + 3 and e.d <= b.d + 10 group by 1, 2, 3) select x.asset_id, x.d, {e4('rsi')} as rsi_e4, e.c > x.c as rose from x join bars e on e.asset_id = x.asset_id and e.d = exit_d join rsi on rsi.asset_id = x.asset_id and rsi.d = x.d"),
    ),
    "j7_latest_of_each": (
        lambda s, d: _latest_of_each(s, d),
        sql("bars fundamentals flows", "select b.asset_id, b.d as bar_d, f.d as flow_d, r.d as report_d from (select asset_id, max(d) as d from bars group by 1) b left join (select asset_id, max(d) as d from flows group by 1) f using (asset_id) left join (select asset_id, max(report_date) as d from fundamentals group by 1) r using (asset_id)"),
    ),
    "j16_bridge": (
        lambda s, d: linked(s, d).join(panel.assets(s, d).select("asset_id", "symbol"), "asset_id"),
        sql("news assets", "select asset_id, article_id, symbol from (select article_id, unnest(list_distinct([article_id % 50 + 1, article_id % 7 + 1])) as asset_id from news) join (select asset_id, symbol from assets) using (asset_id)"),
    ),
    "j18_run_deltas": (
        lambda s, d: _run_deltas(s, d),
        f"with {RUNS} select a.run_id, b.run_id as other_id, b.ret_bp - a.ret_bp as delta_bp from runs a join runs b on b.run_id = a.run_id + 100",
    ),
    "a3_market_sentiment": (
        _article_assets,
        sql("news", f"with {SENT.strip()}, m as (select article_id, cast(floor(s * 1000000 + 0.5) as bigint) as m from sent), b as (select article_id, len(list_distinct([article_id % 50 + 1, article_id % 7 + 1])) + 1 as k from news) select cast(sum(k) as bigint) as n, cast(floor(cast(sum(m * k) as double) / (cast(sum(k) as double) * 100.0::double) + 0.5) as bigint) as mean_e4 from m join b using (article_id)"),
    ),
    "a11_mean_known": (
        lambda s, d: panel.fundamentals(s, d).select("asset_id", "report_date", _e4(sc.mean_known(F.col("pe") / 100.0, F.when(F.col("pb") > 3, F.col("pb") / 13.0))).alias("mean_e4")),
        sql("fundamentals", f"select asset_id, report_date, {e4('case when pe is null and pb <= 3 then 0.5::double else (coalesce(pe / 100.0::double, 0.0::double) + coalesce(case when pb > 3 then pb / 13.0::double end, 0.0::double)) / ((pe is not null)::int + (pb > 3)::int) end')} as mean_e4 from fundamentals"),
    ),
    "a12_win_rate": (
        lambda s, d: _win_rate(s, d),
        sql("bars fundamentals flows", f"{CANDIDATES}, tr as (select x.asset_id, x.d, x.rank, arg_min(e.c, e.d) as sold, any_value(b.c) as paid from cand x join bars b on b.asset_id = x.asset_id and b.d = x.d join bars e on e.asset_id = x.asset_id and e.d > x.d and e.d <= x.exit_d and (e.c <= x.stop or e.c >= x.target or e.d = x.exit_d) where run_id = 1 group by 1, 2, 3) select rank, count(*) as trades, count(*) filter (where sold > paid) as wins, cast(floor(cast(count(*) filter (where sold > paid) * 10000 as double) / count(*) + 0.5) as bigint) as rate_e4 from tr group by rank"),
    ),
    "a17_accuracy": (
        lambda s, d: _accuracy(s, d),
        sql("bars fundamentals flows macro news", f"{HEURISTIC}, fx7 as (select b.asset_id, b.d, b.c, min(e.d) as exit_d from bars b join bars e on e.asset_id = b.asset_id and e.d >= b.d + 7 and e.d <= b.d + 14 group by 1, 2, 3), lb as (select x.asset_id, x.d, case when (e.c - x.c) * 100 >= 2 * x.c then 'UP' when (e.c - x.c) * 100 <= -2 * x.c then 'DOWN' else 'FLAT' end as truth from fx7 x join bars e on e.asset_id = x.asset_id and e.d = x.exit_d) select truth, count(*) as n, count(*) filter (where label = truth) as hits, cast(floor(cast(count(*) filter (where label = truth) * 10000 as double) / count(*) + 0.5) as bigint) as accuracy_e4 from lb join (select asset_id, d, label from hq where horizon = 7) p using (asset_id, d) group by truth"),
    ),
    "a13_sharpe": (
        lambda s, d: _sharpe(s, d),
        sql("bars", f"with {EQ}, x as (select avg(ret_bp) as m, stddev_pop(ret_bp) as s, count(*) as n from eq) select n, round(case when n >= 2 and s > 0 then greatest(-10.0::double, least(10.0::double, m / s * sqrt(252.0::double))) else 0.0::double end, 6) as sharpe from x"),
    ),
    "a14_max_drawdown": (
        lambda s, d: cs.drawdown(_equity(s, d), "equity").agg(F.min("drawdown").alias("deepest"), F.max("peak").alias("peak")),
        sql("bars", f"select min({r4('cast(equity as double) / peak - 1')}) as deepest, max(peak) as peak from (select equity, max(equity) over (order by d) as peak from (select d, cast(sum(c) as bigint) as equity from bars group by d))"),
    ),
    "a19_runs_by_model": (
        lambda s, d: _runs(s, d).groupBy("strategy").agg(F.count_distinct("run_id").alias("n"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run")),
        f"with {RUNS} select strategy, count(distinct run_id) as n, min(run_id) as first_run, max(run_id) as last_run from runs group by 1",
    ),
    "a21_distinct_pairs": (lambda s, d: panel.table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct(), "select distinct l_suppkey, l_partkey from lineitem"),
    "w17_sentiment_mean": (
        lambda s, d: _sentiment_mean(s, d),
        sql("news", f"with {SENT.strip()}, dy as (select published, cast(sum(cast(floor(s * 1000000 + 0.5) as bigint)) as bigint) as m from sent group by 1) select published, cast(sum(m) over (order by published rows between 19 preceding and current row) as bigint) as m20 from dy"),
    ),
    "w20_ma_cross_inputs": (
        lambda s, d: sig.inputs(panel.bars(s, d)).where("row >= 62").select("asset_id", "d", *[_e4(F.col(c)).alias(c) for c in ("ma5", "ma20", "ma5_1", "ma20_1")]),
        sql("bars", "with a as (select *, row_number() over (partition by asset_id order by d) as row, " + ", ".join(f"case when count(c) over w{p} = {p} then cast(sum(c) over w{p} as double) / {float(p)}::double end as ma{p}" for p in (5, 20)) + f" from bars window w5 as ({W} rows between 4 preceding and current row), w20 as ({W} rows between 19 preceding and current row)), b as (select *, lag(ma5) over ({W}) as ma5_1, lag(ma20) over ({W}) as ma20_1 from a) select asset_id, d, " + ", ".join(f"{e4(c)} as {c}" for c in ("ma5", "ma20", "ma5_1", "ma20_1")) + " from b where row >= 62"),
    ),
    "w21_cumulative_nav": (
        lambda s, d: cs.nav(cs.equal_weight(panel.bars(s, d)).select("d", "ret_bp")).select("d", F.round("nav", 2).alias("nav")),
        sql("bars", f"with {EQ} select d, round(exp(sum(ln(1 + ret_bp / 10000.0::double)) over (order by d)) * 100000.0::double, 2) as nav from eq"),
    ),
    "w29_rolling_windows": (
        lambda s, d: bt.windows("1996-01-01", "1999-12-31", 365, 180, s),
        "select cast(a as date) as start_d, least(cast(a as date) + 364, date '1999-12-31') as end_d from unnest(generate_series(timestamp '1996-01-01', timestamp '1999-12-31', interval 180 day)) as t(a)",
    ),
    "r7_continued_nav": (_continued, sql("bars", f"with {EQ}, seed as (select exp(sum(ln(1 + ret_bp / 10000.0::double))) * 100000.0::double as s from eq where d < '1999-01-01') select d, round(s * exp(sum(ln(1 + ret_bp / 10000.0::double)) over (order by d)), 2) as nav from eq, seed where d >= '1999-01-01'")),
    "r4_versioned_upsert": (
        _upsert_versions,
        sql("news", "select url, case when url like '%7' then 3 when length(url) % 2 = 0 then 2 else 1 end as version, source || '-v' || case when url like '%7' then 3 when length(url) % 2 = 0 then 2 else 1 end as source from news"),
    ),
    "r6_high_water_mark": (
        lambda s, d: panel.bars(s, d).groupBy("asset_id").agg(F.date_add(F.max("d"), 1).alias("next_start")),
        sql("bars", "select asset_id, max(d) + 1 as next_start from bars group by 1"),
    ),
    "r11_changed_members": (
        lambda s, d: _changed(s, d),
        sql("membership", "with w as (select trade_date, lag(trade_date) over (order by trade_date) as prev from (select distinct trade_date from membership)), m as (select distinct trade_date, asset_id from membership) select w.trade_date, m.asset_id, 'joined' as change from w join m on m.trade_date = w.trade_date where prev is not null and not exists (select 1 from m x where x.trade_date = w.prev and x.asset_id = m.asset_id) union all select w.trade_date, m.asset_id, 'left' from w join m on m.trade_date = w.prev where not exists (select 1 from m x where x.trade_date = w.trade_date and x.asset_id = m.asset_id)"),
    ),
    "t2_strong_trend": (
        lambda s, d: ind.adx_latest(panel.bars(s, d)).where("adx >= 25").orderBy(F.desc("adx"), "asset_id").limit(20),
        adx_sql("select * from adx where adx >= 25 order by adx desc, asset_id limit 20"),
    ),
    "t3_stochastic_extremes": (
        lambda s, d: _stochastic_extremes(s, d),
        f"with x as ({windows.QUERIES['w7_stochastic'][1]}) select * from (select asset_id, d, slow_k, 'high' as side from x where slow_k >= 80 order by slow_k desc, asset_id, d limit 20) union all select * from (select asset_id, d, slow_k, 'low' as side from x where slow_k <= 20 order by slow_k, asset_id, d limit 20)",
    ),
    "t6_decisions_nulls_last": (
        lambda s, d: sc.decide(decisions_in(s, d)).withColumn("key", F.when(F.col("label") == "UP", F.col("trade_score"))).orderBy(F.col("key").desc_nulls_last(), "asset_id", "horizon").limit(25).select("asset_id", "horizon", "key"),
        sql("bars", f"with {DECISIONS.strip()} select asset_id, horizon, case when label = 'UP' then trade_score end as key from decided order by key desc nulls last, asset_id, horizon limit 25"),
    ),
    "u3_or_union": (
        lambda s, d: panel.table(s, d, "orders").where("o_totalprice > 300000").select("o_orderkey").union(panel.table(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")).distinct(),
        "select o_orderkey from orders where o_totalprice > 300000 union select o_orderkey from orders where o_orderstatus = 'P'",
    ),
    "m2_sentiment_factor": (
        lambda s, d: _sent_micro(s, d).select("article_id", _e4(sc.clamp((F.col("m") / 1000000.0 + 1) / 2, 0.0, 1.0)).alias("factor_e4")),
        sql("news", f"with {SENT.strip()} select article_id, {e4('greatest(0.0::double, least(1.0::double, (cast(floor(s * 1000000 + 0.5) as bigint) / 1000000.0::double + 1) / 2))')} as factor_e4 from sent"),
    ),
    "m21_sentiment_labels": (
        lambda s, d: lexicon.sentiment(_articles(s, d)).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n")),
        sql("news", f"with {SENT.strip()} select source, case when s >= 0.15 then 'POSITIVE' when s <= -0.15 then 'NEGATIVE' else 'NEUTRAL' end as label, count(*) as n from sent group by 1, 2"),
    ),
    "m8_label_counts": (
        lambda s, d: predictions(s, d).groupBy("horizon", "label").agg(F.count(F.lit(1)).alias("n")),
        sql("bars fundamentals flows macro news", f"{HEURISTIC} select horizon, label, count(*) as n from hq group by 1, 2"),
    ),
    "m29_batch_predictions": (
        _batch,
        sql(
            "bars fundamentals flows macro news",
            f"{HEURISTIC}, {INPUTS.strip()}, nq as (select *, row_number() over (partition by asset_id, horizon order by d desc) as r from hq), "
            f"dj as (select di.*, mid + 2 * dev as upper, mid - 2 * dev as lower, cast(di.c as double) as k, di.c * 1.01::double as up1, nq.horizon, nq.label, nq.up, nq.up as p from nq join di on di.asset_id = nq.asset_id and di.d = nq.d where nq.r = 1), {DECIDE.strip()} "
            "select asset_id, d, horizon, label, up, target, stop, reward_risk, trade_score, suggested from decided",
        ),
    ),
    "m30_active_versions": (
        lambda s, d: _registry(s, d).where("status = 'READY'").withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("trained"), F.desc("version")))).select("family", "version", "trained", (F.col("r") == 1).alias("is_active")),
        f"with {REGISTRY} select family, version, trained, row_number() over (partition by family order by trained desc, version desc) = 1 as is_active from reg where status = 'READY'",
    ),
    "m31_feature_scaler": (_scaled, sql("bars", "select " + ", ".join(f"{e4(f'cast(sum({c}) as double) / count({c})')} as {c}_mean, {e4(f'sqrt(cast(count({c}) * sum({c} * {c}) - sum({c}) * sum({c}) as double)) / count({c})')} as {c}_dev" for c in ("c", "v")) + " from bars where d < '1999-01-01'")),
    "m32_macro_upsert": (
        lambda s, d: sinks.upserted(panel.macro(s, d).select("date", "pmi"), panel.macro(s, d).where("pmi is null").select("date", F.lit(50).cast("long").alias("pmi")), "date"),
        sql("macro", "select date, coalesce(pmi, 50) as pmi from macro"),
    ),
    "b2_prediction_map": (
        lambda s, d: predictions(s, d).groupBy("asset_id", "d").pivot("horizon", [3, 7, 30]).agg(F.first("up")).withColumnsRenamed({"3": "up_3", "7": "up_7", "30": "up_30"}),
        sql("bars fundamentals flows macro news", f"{HEURISTIC} select asset_id, d, max(case when horizon = 3 then up end) as up_3, max(case when horizon = 7 then up end) as up_7, max(case when horizon = 30 then up end) as up_30 from hq group by 1, 2"),
    ),
    "b4_top_by_trade_score": (
        lambda s, d: sc.top_k(sc.decide(decisions_in(s, d)), 5, F.desc("trade_score"), F.asc("asset_id"), by="horizon").select("horizon", "rank", "asset_id", "trade_score"),
        sql("bars", f"with {DECISIONS.strip()} select horizon, rank, asset_id, trade_score from (select *, row_number() over (partition by horizon order by trade_score desc, asset_id) as rank from decided) where rank <= 5"),
    ),
    "b13_entry_decisions": (lambda s, d: candidates(s, d)[0].select("run_id", "asset_id", "d", "rank", "exit_d", "target", "stop"), sql("bars fundamentals flows", f"{CANDIDATES} select run_id, asset_id, d, rank, exit_d, target, stop from cand")),
    "k5_export_decisions": (
        lambda s, d: sc.decide(decisions_in(s, d)).where("suggested").select("asset_id", "horizon", F.format_string("%.2f", "target").alias("target_text"), F.date_format("d", "yyyy-MM-dd").alias("day")),
        sql("bars", f"with {DECISIONS.strip()} select asset_id, horizon, printf('%.2f', target) as target_text, strftime(d, '%Y-%m-%d') as day from decided where suggested"),
    ),
    "qf_grouped_predictions": (
        lambda s, d: predictions(s, d).groupBy("asset_id", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("horizon", "label"))), lambda x: F.concat_ws(":", x["horizon"].cast("string"), x["label"])), ",").alias("labels")),
        sql("bars fundamentals flows macro news", f"{HEURISTIC} select asset_id, d, array_to_string(list(horizon || ':' || label order by horizon), ',') as labels from hq group by 1, 2"),
    ),
    "qh_model_audit": (
        lambda s, d: factors(s, d).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) == 0.5).alias(f"{c}_neutral") for c in ("fundamental", "flow")], F.count_if(F.col("technical") == 0).alias("technical_zero"), F.max("d").alias("last_d")),
        sql("bars fundamentals flows", f"{FACTORS} select count(*) as n, count(*) filter (where fundamental = 0.5) as fundamental_neutral, count(*) filter (where flow = 0.5) as flow_neutral, count(*) filter (where technical = 0) as technical_zero, max(d) as last_d from factor"),
    ),
    "qi_new_universe": (
        lambda s, d: panel.assets(s, d).where(F.array_contains("tags", "IDX_B") & ~F.array_contains("tags", "IDX_A")).select("asset_id", "symbol"),
        sql("assets", "select asset_id, symbol from assets where list_contains(tags, 'IDX_B') and not list_contains(tags, 'IDX_A')"),
    ),
    "ql_phase_calendar": (
        lambda s, d: _phase_days(s, d),
        sql("bars calendar macro", f"with {PHASES.strip()} select phase, count(*) as days from (select c.d, p.phase from calendar c asof join ph p on c.d >= p.date) group by 1"),
    ),
}


def _stochastic_extremes(s, d):
    """The 20 highest rows from 80 up and the 20 lowest from 20 down, of slow %K on its scale of 100."""
    x = ind.stochastic(panel.bars(s, d)).select("asset_id", "d", "slow_k")
    high = x.where("slow_k >= 80").orderBy(F.desc("slow_k"), "asset_id", "d").limit(20).withColumn("side", F.lit("high"))
    return high.unionByName(x.where("slow_k <= 20").orderBy("slow_k", "asset_id", "d").limit(20).withColumn("side", F.lit("low")))


def _daily_basic(s, d):
    """Raw rows of a provider, all text, as typed columns: dates that are none go, numbers that are none are null."""
    o = panel.table(s, d, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("ts_code"), F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("n/a")).alias("trade_date"), F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 90).cast("string")).otherwise(F.lit("-")).alias("pe"))
    return raw.select(F.col("ts_code").cast("long").alias("asset_id"), F.expr("try_to_date(trade_date, 'yyyyMMdd')").alias("d"), F.expr("try_cast(pe as double)").alias("pe")).where("d is not null")


def _win_rate(s, d):
    """Trades of the candidates by place: sold at the first bar past stop or target, or at the planned exit; won if above the entry."""
    x, bars, _ = candidates(s, d)
    bars = bars.join(F.broadcast(x.select("asset_id").distinct()), "asset_id", "left_semi")
    entry = x.where("run_id = 1").join(bars.select("asset_id", "d", F.col("c").alias("paid")), ["asset_id", "d"])
    days = entry.withColumn("on", F.explode(F.sequence(F.date_add("d", 1), F.col("exit_d"), F.expr("interval 1 day"))))
    seen = days.join(bars.select("asset_id", F.col("d").alias("on"), "c"), ["asset_id", "on"]).where("c <= stop or c >= target or on = exit_d")
    sold = seen.groupBy("asset_id", "d", "rank").agg(F.min_by("c", "on").alias("sold"), F.first("paid").alias("paid"))
    out = sold.groupBy("rank").agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("sold") > F.col("paid")).alias("wins"))
    return out.withColumn("rate_e4", F.floor(F.col("wins") * 10000 / F.col("trades") + 0.5))


def _accuracy(s, d):
    """Share of the seven-day predictions that came true, by what happened."""
    truth = _labels(s, d).select("asset_id", "d", F.col("label").alias("truth"))
    both = predictions(s, d).where("horizon = 7").select("asset_id", "d", "label").join(truth, ["asset_id", "d"])
    out = both.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("truth")).alias("hits"))
    return out.withColumn("accuracy_e4", F.floor(F.col("hits") * 10000 / F.col("n") + 0.5))


def _index_daily(s, d):
    tagged = panel.assets(s, d).select("asset_id", F.explode("tags").alias("index_code"))
    return panel.bars(s, d).join(tagged, "asset_id").groupBy("index_code", "d").agg(F.sum("c").alias("level"), F.count(F.lit(1)).alias("n"))


def _top_concepts(s, d):
    h = lexicon.tags(panel.news(s, d)).select("published", F.explode("tags").alias("tag"))
    last = h.agg(F.max("published").alias("last"))
    return h.join(F.broadcast(last), h["published"] == last["last"]).groupBy("tag").agg(F.count(F.lit(1)).alias("heat")).orderBy(F.desc("heat"), "tag").limit(20)


def _features_labels(s, d):
    bars = panel.bars(s, d)
    x = ind.rsi_columns(bars).select("asset_id", "d", _e4(F.col("rsi")).alias("rsi_e4"))
    y = pit.next_row(bars, 3).where("exit_d is not null").select("asset_id", "d", (F.col("exit_c") > F.col("c")).alias("rose"))
    return x.join(y, ["asset_id", "d"])


def _latest_of_each(s, d):
    out = panel.bars(s, d).groupBy("asset_id").agg(F.max("d").alias("bar_d"))
    out = out.join(panel.flows(s, d).groupBy("asset_id").agg(F.max("d").alias("flow_d")), "asset_id", "left")
    return out.join(panel.fundamentals(s, d).groupBy("asset_id").agg(F.max("report_date").alias("report_d")), "asset_id", "left")


def _run_deltas(s, d):
    a = _runs(s, d)
    b = _runs(s, d).select(F.col("run_id").alias("other_id"), F.col("ret_bp").alias("other_bp"), (F.col("run_id") - 100).alias("back"))
    return a.join(b, F.col("run_id") == F.col("back")).select("run_id", "other_id", (F.col("other_bp") - F.col("ret_bp")).alias("delta_bp"))


def _sharpe(s, d):
    r = cs.equal_weight(panel.bars(s, d)).agg(F.avg("ret_bp").alias("m"), F.stddev_pop("ret_bp").alias("s"), F.count(F.lit(1)).alias("n"))
    value = F.when((F.col("n") >= 2) & (F.col("s") > 0), sc.clamp(F.col("m") / F.col("s") * F.sqrt(F.lit(252.0)), -10.0, 10.0)).otherwise(F.lit(0.0))
    return r.select("n", F.round(value, 6).alias("sharpe"))


def _sentiment_mean(s, d):
    day = _sent_micro(s, d).groupBy("published").agg(F.sum("m").alias("m"))
    return day.select("published", F.sum("m").over(Window.orderBy("published").rowsBetween(-19, 0)).alias("m20"))  # one row a day


def _changed(s, d):
    m = panel.membership(panel.calendar(panel.bars(s, d)), panel.assets(s, d)).select("trade_date", "asset_id").distinct()
    order = Window.orderBy("trade_date")  # one row a month
    shots = m.select("trade_date").distinct().select("trade_date", F.lag("trade_date").over(order).alias("prev"), F.lead("trade_date").over(order).alias("next"))
    x = m.join(F.broadcast(shots), "trade_date")
    here = m.select(F.col("trade_date").alias("at"), "asset_id")
    joined = x.where("prev is not null").join(here.withColumnRenamed("at", "prev"), ["prev", "asset_id"], "left_anti").select("trade_date", "asset_id", F.lit("joined").alias("change"))
    left = x.where("next is not null").join(here.withColumnRenamed("at", "next"), ["next", "asset_id"], "left_anti").select(F.col("next").alias("trade_date"), "asset_id", F.lit("left").alias("change"))
    return joined.unionByName(left)


def _phase_days(s, d):
    m = panel.macro(s, d).where("pmi is not null")
    slope = F.col("pmi") - F.lag("pmi").over(Window.orderBy("date"))
    m = m.withColumn("phase", sc.phase(F.col("pmi"), slope, F.col("non_pmi"), F.col("cpi10") / 10.0))
    starts = m.select(F.col("date").alias("starts_at"), F.col("phase").alias("label"))
    days = pit.containing(panel.calendar(panel.bars(s, d)), pit.closed_intervals(starts))
    return days.where("label is not null").groupBy(F.col("label").alias("phase")).agg(F.count(F.lit(1)).alias("days"))


