"""Queries of time-aware joins and ranks across assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crosssection as cs
from ..operators import pointintime as pit
from ..sources import panel
from .cte import sql
from .windows import W, r4

PHASES = [("OVERHEAT", 3), ("RECESSION", 0), ("RECOVERY", 1), ("STAGFLATION", 2)]


def contexts(spark, sf):
    """Macro months as intervals; some months are missing, so that days fall into the interval before."""
    months = panel.macro(spark, sf).where("pmi is not null")
    label = F.when(F.col("pmi") < 50, F.lit("RECESSION")).when(F.col("non_pmi") >= 53, F.lit("OVERHEAT")).otherwise(F.lit("RECOVERY"))
    return pit.closed_intervals(months.select(F.col("date").alias("starts_at"), label.alias("label")))


CONTEXTS = """
ctx as (select starts_at, label, lead(starts_at) over (order by starts_at) - 1 as ends_at
        from (select date as starts_at, case when pmi < 50 then 'RECESSION' when non_pmi >= 53 then 'OVERHEAT' else 'RECOVERY' end as label from macro where pmi is not null))"""

MEMBERS = """
shots as (select distinct index_code, trade_date from membership),
picked as (select c.d, s.index_code, max(s.trade_date) as snapshot from calendar c join shots s on s.trade_date <= c.d group by 1, 2),
on_day as (select p.d, m.asset_id, list_sort(list(distinct m.index_code)) as indexes from picked p join membership m on m.index_code = p.index_code and m.trade_date = p.snapshot group by 1, 2)"""

RET = f"""
pairs as (select d, lag(d) over (order by d) as prev_d from calendar),
moved as (select b.asset_id, b.d, b.c, p.c as prev_c, len(o.indexes) > 1 as overlap from bars b join pairs using (d)
          join bars p on p.asset_id = b.asset_id and p.d = pairs.prev_d join on_day o on o.d = b.d and o.asset_id = b.asset_id),
shared as (select m.*, f.free_share from moved m asof left join (select asset_id, available_date, max(free_share) as free_share from fundamentals group by 1, 2) f
           on m.asset_id = f.asset_id and m.d >= f.available_date),
ret as (select d, cast(sum(coalesce(free_share, 1) * c * cast(floor((c - prev_c) * 10000.0::double / prev_c + 0.5) as bigint)) as double) / cast(sum(coalesce(free_share, 1) * c) as double) as ret_bp,
               count(*) as n, count(*) filter (where overlap) as overlap from shared group by d)"""


def _asof_fundamentals(s, d):
    facts = panel.fundamentals(s, d).select("asset_id", "available_date", "pb", "roe_bp")
    return pit.asof(panel.bars(s, d).select("asset_id", "d", "c"), facts, "asset_id", "d", "available_date", "pb", "roe_bp")


def _returns(s, d):
    bars = panel.shared_bars(s, d)
    return cs.weighted_returns(bars, panel.membership(panel.calendar(bars), panel.assets(s, d)), panel.fundamentals(s, d))


def _members(s, d):
    days = panel.calendar(panel.bars(s, d))
    return pit.members_on(days, panel.membership(days, panel.assets(s, d)))


def with_label(rows, h=7):
    """``rows`` (one a bar, with its asset_id, d and c) and the label at ``h`` days, null without a bar then; in the rows' own partitions."""
    move = (F.col("exit_c") - F.col("c")) * 100
    label = F.when(move >= 2 * F.col("c"), "UP").when(move <= -2 * F.col("c"), "DOWN").otherwise("FLAT")
    return pit.next_row(rows, h).withColumn("label", F.when(F.col("exit_d").isNotNull(), label)).drop("exit_c")


def _labels(s, d, h=7):
    return with_label(panel.bars(s, d), h).where("exit_d is not null").select("asset_id", "d", "exit_d", "label")


def _three_sides(s, d):
    """Completeness: bars without a flow, fundamentals report or RS score of their own, by kind."""
    bars = panel.bars(s, d)
    keys = bars.select("asset_id", "d")
    flows = panel.flows(s, d).where("lg_buy > 0").select("asset_id", "d")
    months = panel.fundamentals(s, d).select("asset_id", F.col("report_date").alias("m"))
    scores = cs.rs_score(bars).select("asset_id", "d")
    missing = [
        ("flow", keys.join(flows, ["asset_id", "d"], "left_anti")),
        ("fundamental", keys.withColumn("m", F.trunc("d", "MM")).join(months, ["asset_id", "m"], "left_anti").select("asset_id", "d")),
        ("rs_score", keys.join(scores, ["asset_id", "d"], "left_anti")),
    ]
    out = None
    for name, frame in missing:
        part = frame.select("asset_id", "d", F.lit(name).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "j1_asset_markets": (
        lambda s, d: panel.bars(s, d).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_bars")).join(panel.assets(s, d).select("asset_id", "symbol", "market", "active"), "asset_id", "left"),
        sql("bars assets", "select b.asset_id, n_bars, symbol, market, active from (select asset_id, count(*) as n_bars from bars group by 1) b left join assets using (asset_id)"),
    ),
    "j3_asof_fundamentals": (
        _asof_fundamentals,
        sql("bars fundamentals", "select b.asset_id, b.d, b.c, f.pb, f.roe_bp from bars b asof left join fundamentals f on b.asset_id = f.asset_id and b.d >= f.available_date"),
    ),
    "j4_index_membership": (
        lambda s, d: _members(s, d).select("d", "asset_id", F.array_join("indexes", ",").alias("indexes"), "overlap"),
        sql("bars assets calendar membership", f"with {MEMBERS.strip()} select d, asset_id, array_to_string(indexes, ',') as indexes, len(indexes) > 1 as overlap from on_day"),
    ),
    "j5_snapshot_intervals": (
        lambda s, d: pit.snapshot_intervals(panel.membership(panel.calendar(panel.bars(s, d)), panel.assets(s, d))),
        sql("membership", "select index_code, trade_date, lead(trade_date) over (partition by index_code order by trade_date) - 1 as valid_to from (select distinct index_code, trade_date from membership)"),
    ),
    "j6_latest_fundamentals": (
        lambda s, d: pit.latest(panel.fundamentals(s, d).where("available_date <= '1999-12-31'").select("asset_id", "report_date", "pe", "pb"), "asset_id", "report_date"),
        sql("fundamentals", "select asset_id, max(report_date) as report_date, arg_max(pe, report_date) as pe, arg_max(pb, report_date) as pb from (select asset_id, report_date, coalesce(pe, -1) as pe, pb from fundamentals where available_date <= '1999-12-31') group by 1").replace("arg_max(pe, report_date) as pe", "nullif(arg_max(pe, report_date), -1) as pe"),
    ),
    "j8_context_of_day": (
        lambda s, d: pit.containing(panel.calendar(panel.bars(s, d)), contexts(s, d)),
        sql("calendar macro", f"with {CONTEXTS.strip()}, x as (select d, starts_at, label, ends_at is null or ends_at >= d as inside, row_number() over (partition by d order by (ends_at is null or ends_at >= d) desc, starts_at desc) as r from calendar left join ctx on starts_at <= d) select d, label, coalesce(inside and label is not null, false) as inside from x where r = 1"),
    ),
    "j9_interval_coverage": (
        lambda s, d: pit.coverage(panel.calendar(panel.bars(s, d)), contexts(s, d)),
        sql("calendar macro", f"with {CONTEXTS.strip()} select d, count(starts_at) as n from calendar left join ctx on starts_at <= d and (ends_at is null or ends_at >= d) group by d"),
    ),
    "j10_missing_rows": (
        _three_sides,
        sql(
            "bars flows fundamentals",
            f"""select asset_id, d, 'flow' as kind from bars b where not exists (select 1 from flows f where f.asset_id = b.asset_id and f.d = b.d and lg_buy > 0)
            union all select asset_id, d, 'fundamental' from bars b where not exists (select 1 from fundamentals f where f.asset_id = b.asset_id and f.report_date = date_trunc('month', b.d))
            union all select asset_id, d, 'rs_score' from (select asset_id, d, row_number() over ({W}) as r from bars) where r <= 20""",
        ),
    ),
    "j11_forward_rows": (
        lambda s, d: pit.next_row(panel.bars(s, d), 7).select("asset_id", "d", "exit_d", "exit_c"),
        sql("bars", "with x as (select b.asset_id, b.d, min(e.d) as exit_d from bars b left join bars e on e.asset_id = b.asset_id and e.d >= b.d + 7 and e.d <= b.d + 14 group by 1, 2) select x.asset_id, x.d, exit_d, e.c as exit_c from x left join bars e on e.asset_id = x.asset_id and e.d = exit_d"),
    ),
    "m12_labels": (
        _labels,
        sql("bars", "with x as (select b.asset_id, b.d, b.c, min(e.d) as exit_d from bars b join bars e on e.asset_id = b.asset_id and e.d >= b.d + 7 and e.d <= b.d + 14 group by 1, 2, 3) select x.asset_id, x.d, exit_d, case when (e.c - x.c) * 100 >= 2 * x.c then 'UP' when (e.c - x.c) * 100 <= -2 * x.c then 'DOWN' else 'FLAT' end as label from x join bars e on e.asset_id = x.asset_id and e.d = exit_d"),
    ),
    "j12_semi_join": (
        lambda s, d: panel.assets(s, d).select("asset_id", "symbol").join(panel.flows(s, d).where("lg_buy >= 100").select("asset_id"), "asset_id", "left_semi"),
        sql("assets flows", "select asset_id, symbol from assets where asset_id in (select asset_id from flows where lg_buy >= 100)"),
    ),
    "j13_full_outer_mean": (
        lambda s, d: _two_scores(s, d),
        sql("bars flows", f"""with a as (select asset_id, cast(sum(v) as bigint) as x from bars where v > 40 group by 1), b as (select asset_id, cast(sum(lg_buy) as bigint) as y from flows where lg_buy > 80 group by 1)
        select coalesce(a.asset_id, b.asset_id) as asset_id, x, y, (coalesce(x, 0) + coalesce(y, 0)) / cast((x is not null)::int + (y is not null)::int as double) as score from a full join b on a.asset_id = b.asset_id"""),
    ),
    "j14_asset_horizons": (
        lambda s, d: panel.assets(s, d).where("active").select("asset_id").crossJoin(F.broadcast(s.createDataFrame([(3,), (7,), (30,)], "horizon int"))),
        sql("assets", "select asset_id, horizon from assets, (values (3), (7), (30)) as h(horizon) where active"),
    ),
    "j15_previous_market_day": (
        lambda s, d: _previous(s, d),
        sql("bars calendar", "with p as (select d, lag(d) over (order by d) as prev_d from calendar) select b.asset_id, b.d, p.prev_d, b.c, q.c as prev_c from bars b join p using (d) join bars q on q.asset_id = b.asset_id and q.d = p.prev_d"),
    ),
    "w18_percentile_rank": (
        lambda s, d: panel.fundamentals(s, d).select("asset_id", "report_date", "pe", cs.four(cs.percentile("pe", "report_date")).alias("pe_rank")),
        sql("fundamentals", f"select asset_id, report_date, pe, case when pe is not null then {r4('cast(count(pe) over (partition by report_date order by pe range between unbounded preceding and current row) as double) / count(pe) over (partition by report_date)')} end as pe_rank from fundamentals"),
    ),
    "w19_rs_score": (
        lambda s, d: cs.rs_score(panel.bars(s, d)),
        sql("bars", f"""with m as (select asset_id, d, (c - lag(c, 20) over ({W})) * 1.0::double / lag(c, 20) over ({W}) as ret from bars),
        r as (select asset_id, d, row_number() over (partition by d order by ret desc, asset_id) as rank, count(*) over (partition by d) as n from m where ret is not null)
        select asset_id, d, rank, {r4('1 - cast(rank - 1 as double) / n')} as rs_score, rank <= greatest(1, floor(n * 0.2::double)) as leads from r"""),
    ),
    "g10_high_rs": (
        lambda s, d: cs.rs_score(panel.bars(s, d)).where("leads").select("asset_id", "d", F.lit("HIGH_RS_SCORE").alias("signal_type")),
        sql("bars", f"""with m as (select asset_id, d, (c - lag(c, 20) over ({W})) * 1.0::double / lag(c, 20) over ({W}) as ret from bars),
        r as (select asset_id, d, row_number() over (partition by d order by ret desc, asset_id) as rank, count(*) over (partition by d) as n from m where ret is not null)
        select asset_id, d, 'HIGH_RS_SCORE' as signal_type from r where rank <= greatest(1, floor(n * 0.2::double))"""),
    ),
    "a9_weighted_return": (
        lambda s, d: _returns(s, d).select("d", cs.four(F.col("ret_bp")).alias("ret_bp"), "n", "overlap"),
        sql("bars assets calendar membership fundamentals", f"with {MEMBERS.strip()}, {RET.strip()} select d, {r4('ret_bp')} as ret_bp, n, overlap from ret"),
    ),
    "m25_pit_nav": (
        lambda s, d: cs.nav(_returns(s, d)).select("d", F.round("nav", 2).alias("nav")),
        sql("bars assets calendar membership fundamentals", f"with {MEMBERS.strip()}, {RET.strip()} select d, round(exp(sum(ln(1 + ret_bp / 10000.0::double)) over (order by d)) * 100000.0::double, 2) as nav from ret"),
    ),
    "a10_equal_weight": (
        lambda s, d: cs.equal_weight(panel.bars(s, d)).select("d", cs.four(F.col("ret_bp")).alias("ret_bp"), "n"),
        sql("bars", f"with x as (select d, cast(floor((c - lag(c) over ({W})) * 10000.0::double / lag(c) over ({W}) + 0.5) as bigint) as bp from bars) select d, {r4('cast(sum(bp) as double) / cast(count(bp) as double)')} as ret_bp, count(bp) as n from x where bp is not null group by d"),
    ),
    "w22_drawdown": (
        lambda s, d: cs.drawdown(panel.bars(s, d).groupBy("d").agg(F.sum("c").alias("total")), "total"),
        sql("bars", f"select d, total, peak, {r4('cast(total as double) / peak - 1')} as drawdown from (select d, total, max(total) over (order by d) as peak from (select d, cast(sum(c) as bigint) as total from bars group by d))"),
    ),
    "w23_gaps": (
        lambda s, d: pit.gaps(panel.bars(s, d), panel.calendar(panel.bars(s, d))),
        sql("bars calendar", f"with n as (select d, row_number() over (order by d) as no from calendar), x as (select asset_id, no, lead(no) over (partition by asset_id order by no) as nx from bars join n using (d)) select asset_id, a.d as gap_start, b.d as gap_end, nx - x.no - 1 as missing from x join n a on a.no = x.no + 1 join n b on b.no = nx - 1 where nx - x.no > 1"),
    ),
    "w24_closed_contexts": (lambda s, d: contexts(s, d), sql("macro", f"with {CONTEXTS.strip()} select starts_at, label, ends_at from ctx")),
    "w26_rebase": (
        lambda s, d: _rebased(s, d),
        sql("bars", f"select asset_id, d, {r4(f'c * 100000.0::double / first_value(c) over ({W})')} as value from bars"),
    ),
}


def _two_scores(s, d):
    a = panel.bars(s, d).where("v > 40").groupBy("asset_id").agg(F.sum("v").alias("x"))
    b = panel.flows(s, d).where("lg_buy > 80").groupBy("asset_id").agg(F.sum("lg_buy").alias("y"))
    both = a.join(b, "asset_id", "full")
    known = F.col("x").isNotNull().cast("int") + F.col("y").isNotNull().cast("int")
    return both.withColumn("score", (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))) / known.cast("double"))


def _previous(s, d):
    bars = panel.bars(s, d)
    now = bars.select("asset_id", "d", "c").join(F.broadcast(pit.day_pairs(panel.calendar(bars))), "d")
    return now.join(bars.select("asset_id", F.col("d").alias("prev_d"), F.col("c").alias("prev_c")), ["asset_id", "prev_d"])


def _rebased(s, d):
    from ..functions.columns import by_asset

    return panel.bars(s, d).select("asset_id", "d", cs.four(F.col("c") * 100000.0 / F.first("c").over(by_asset())).alias("value"))
