"""Window, time-series and signal queries."""

from __future__ import annotations

from ..operators import indicators as ind
from ..operators import signals as sig
from ..sources import panel
from .cte import sql

R4 = "floor(({}) * 10000 + 0.5) / 10000"
W = "partition by asset_id order by d"


def r4(x: str) -> str:
    return R4.format(x)


def mean_sql(x: str, n: int, end: int = 0) -> str:
    w = f"over ({W} rows between {n - 1 + end} preceding and {f'{end} preceding' if end else 'current row'})"
    return f"(case when count({x}) {w} = {n} then cast(sum({x}) {w} as double) / {float(n)}::double end)"


def spread_sql(x: str, n: int) -> str:
    w = f"over ({W} rows between {n - 1} preceding and current row)"
    return f"(case when count({x}) {w} = {n} then sqrt(cast({n} * sum({x} * {x}) {w} - sum({x}) {w} * sum({x}) {w} as double)) / {float(n)}::double end)"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) over ({W})"


RSI = f"""
rsi_d as (select *, c - {lag('c', 1)} as diff from bars),
rsi_s as (select *, sum(greatest(diff, 0)) over w as gains, sum(greatest(-diff, 0)) over w as losses, count(diff) over w as k
          from rsi_d window w as ({W} rows between 13 preceding and current row)),
rsi as (select asset_id, d, c, h, l, v, case when k = 14 and losses > 0 then 100 - 100 / (1 + cast(gains as double) / cast(losses as double)) else 50.0::double end as rsi from rsi_s)"""

OBV = f"""
obv_s as (select *, case when {lag('c', 1)} is null or c > {lag('c', 1)} then v when c < {lag('c', 1)} then -v else 0 end as signed from {{src}}),
obv as (select *, cast(sum(signed) over ({W}) as bigint) as obv from obv_s)"""

SIGNALS = f"""
with {RSI.strip()}, {OBV.format(src='rsi').strip()},
sig_a as (select *, row_number() over ({W}) as row, {mean_sql('c', 5)} as ma5, {mean_sql('c', 10)} as ma10, {mean_sql('c', 20)} as ma20, {mean_sql('c', 60)} as ma60,
                 {spread_sql('c', 20)} as dev, {mean_sql('v', 20, 1)} as prior, {lag('c', 5)} as c5 from obv),
sig_b as (select *, ma20 + 2 * dev as upper, ma20 - 2 * dev as lower, {lag('ma5', 1)} as ma5_1, {lag('ma20', 1)} as ma20_1, {lag('obv', 5)} as obv5 from sig_a)"""


def signal_sql(*names: str) -> str:
    selects = " union all ".join(f"select asset_id, d, '{n}' as signal_type from sig_b where {sig.RULES[n]}" for n in names or tuple(sig.RULES))
    return sql("bars", f"{SIGNALS} {selects}")


def _bars(op):
    return lambda spark, sf: op(panel.bars(spark, sf))


def _fold(body: str) -> str:
    return sql("bars", f"with cl as (select asset_id, list(cast(c as double) order by d) as x from bars group by asset_id) {body}")


def _ema(n: int, x: str = "x") -> str:
    seed = f"list_reduce(list_prepend(0.0::double, {x}[1:{n}]), lambda a, b: a + b) / {float(n)}::double"
    return f"(case when len({x}) >= {n} then list_reduce(list_prepend({seed}, {x}[{n + 1}:]), lambda e, b: e + (b - e) * {2 / (n + 1)!r}::double) end)"


def _wilder(sign: str) -> str:
    part = f"greatest({sign}b, 0.0::double)"
    seed = f"list_reduce(list_prepend(0.0::double, y[1:14]), lambda a, b: a + {part}) / 14.0::double"
    return f"list_reduce(list_prepend({seed}, y[15:]), lambda a, b: (a * 13 + {part}) / 14.0::double)"


#: Wilder's sums, row by row: the first 14 are added up, then a fourteenth goes for each that comes.
ADX = f"""
mv as (select asset_id, row_number() over ({W}) - 1 as k, h - {lag('h', 1)} as up, {lag('l', 1)} - l as dn, cast(greatest(h - l, abs(h - {lag('c', 1)}), abs(l - {lag('c', 1)})) as double) as t from bars),
dm as (select asset_id, k, t, case when up > dn and up > 0 then cast(up as double) else 0.0::double end as p, case when dn > up and dn > 0 then cast(dn as double) else 0.0::double end as m from mv where k >= 1),
ws as (select asset_id, k, p, m, t from dm where k = 1
       union all select dm.asset_id, dm.k, case when dm.k <= 14 then ws.p + dm.p else ws.p - ws.p / 14.0::double + dm.p end, case when dm.k <= 14 then ws.m + dm.m else ws.m - ws.m / 14.0::double + dm.m end,
                        case when dm.k <= 14 then ws.t + dm.t else ws.t - ws.t / 14.0::double + dm.t end from ws join dm on dm.asset_id = ws.asset_id and dm.k = ws.k + 1),
dx as (select *, case when p + m > 0 then 100 * abs(p - m) / (p + m) else 0.0::double end as x from ws where k >= 14),
ax as (select asset_id, k, x, sum(x) over (partition by asset_id order by k rows between unbounded preceding and current row) as s from dx),
ad as (select asset_id, k, s / 14.0::double as adx from ax where k = 27
       union all select ax.asset_id, ax.k, (ad.adx * 13 + ax.x) / 14.0::double from ad join ax on ax.asset_id = ad.asset_id and ax.k = ad.k + 1),
adx as (select ws.asset_id, {r4('100 * p / t')} as plus_di, {r4('100 * m / t')} as minus_di, {r4('adx')} as adx
        from ad join ws using (asset_id, k) where k = (select max(k) from dm where dm.asset_id = ad.asset_id))"""


def adx_sql(body: str) -> str:
    return sql("bars", f"with {ADX.strip()} {body}").replace("with ", "with recursive ", 1)


QUERIES = {
    "s0_bars": (panel.bars, sql("bars", "select asset_id, d, c, h, l, v from bars")),
    "w2_rsi_rolling": (
        lambda s, d: ind.rsi_columns(panel.bars(s, d)).select("asset_id", "d", ind.four(ind.F.col("rsi")).alias("rsi")),
        sql("bars", f"with {RSI.strip()} select asset_id, d, {r4('rsi')} as rsi from rsi"),
    ),
    "w4_bollinger": (
        _bars(ind.bollinger),
        sql(
            "bars",
            f"with x as (select asset_id, d, c, {mean_sql('c', 20)} as mid, {spread_sql('c', 20)} as dev from bars) "
            f"select asset_id, d, c, {r4('mid')} as middle, {r4('mid + 2.0::double * dev')} as upper, {r4('mid - 2.0::double * dev')} as lower from x where mid is not null",
        ),
    ),
    "w5_sma": (_bars(ind.sma), sql("bars", f"select asset_id, d, {', '.join(f'{r4(mean_sql("c", p))} as sma_{p}' for p in ind.SMA_PERIODS)} from bars")),
    "w7_stochastic": (
        _bars(ind.stochastic),
        sql(
            "bars",
            f"""with a as (select *, row_number() over ({W}) as row, min(l) over w as lo, max(h) over w as hi from bars window w as ({W} rows between 13 preceding and current row)),
            b as (select *, case when row >= 14 then case when hi > lo then cast(floor((c - lo) * 1000000.0::double / (hi - lo) + 0.5) as bigint) else 0 end end as fast from a),
            c3 as (select *, case when count(fast) over w = 3 then sum(fast) over w end as slow3 from b window w as ({W} rows between 2 preceding and current row)),
            d3 as (select *, case when count(slow3) over w = 3 then sum(slow3) over w end as d9 from c3 window w as ({W} rows between 2 preceding and current row))
            select asset_id, d, {r4('cast(slow3 as double) / 30000.0::double')} as slow_k, {r4('cast(d9 as double) / 90000.0::double')} as slow_d from d3 where d9 is not null""",
        ),
    ),
    "w8_changes": (
        _bars(ind.changes),
        sql("bars", f"select asset_id, d, {', '.join(f'{r4(f"cast(c - {lag("c", n)} as double) / {lag("c", n)}")} as ret_{n}' for n in (1, 3, 5, 10, 20))}, c - {lag('c', 5)} as diff_5 from bars"),
    ),
    "w10_obv": (_bars(ind.obv), sql("bars", f"with {OBV.format(src='bars').strip()} select asset_id, d, obv from obv")),
    "w11_fibonacci": (
        _bars(ind.fibonacci),
        sql(
            "bars",
            f"with a as (select asset_id, d, row_number() over ({W}) as row, min(l) over w as lo, max(h) over w as hi from bars window w as ({W} rows between 59 preceding and current row)) "
            f"select asset_id, d, {', '.join(f'{r4(f"hi - (hi - lo) * {x}::double")} as fib_{int(x * 1000)}' for x in ind.FIB_LEVELS)} from a where row >= 60 and hi > lo",
        ),
    ),
    "w12_momentum": (
        _bars(ind.momentum),
        sql("bars", f"select * from (select asset_id, d, {', '.join(f'{r4(f"cast(c - {lag("c", n)} as double) / {lag("c", n)}")} as mom_{n}d' for n in (5, 10, 20))} from bars) where mom_5d is not null"),
    ),
    "w13_flow_windows": (
        lambda s, d: ind.flow_windows(panel.flows(s, d)),
        sql("flows", f"select asset_id, d, cast(sum(lg_buy - lg_sell) over ({W} rows between 4 preceding and current row) as bigint) as main_force_5d, balance - {lag('balance', 5)} as margin_change_5d from flows"),
    ),
    "w14_relative_volume": (
        _bars(ind.relative_volume),
        sql("bars", "select asset_id, d, " + ", ".join(r4(f"coalesce(cast(v * count(v) over w{n} as double) / nullif(cast(sum(v) over w{n} as double), 0), 1.0::double)") + f" as rel_volume_{n}" for n in (5, 20)) + f" from bars window w5 as ({W} rows between 4 preceding and current row), w20 as ({W} rows between 19 preceding and current row)"),
    ),
    "w15_realized_volatility": (
        _bars(ind.realized_volatility),
        sql(
            "bars",
            f"""with a as (select asset_id, d, coalesce(cast(floor(cast((c - {lag('c', 1)}) * 10000 as double) / {lag('c', 1)} + 0.5) as bigint), 0) as bp from bars)
            select asset_id, d, {r4('case when count(bp) over w >= 2 then sqrt(cast(count(bp) over w * sum(bp * bp) over w - sum(bp) over w * sum(bp) over w as double)) / cast(count(bp) over w as double) else 0.0::double end')} as volatility_bp
            from a window w as ({W} rows between 4 preceding and current row)""",
        ),
    ),
    "w16_lag_features": (
        _bars(ind.lag_features),
        sql("bars", f"with {RSI.strip()} select asset_id, d, " + ", ".join(f"{r4(f'coalesce({lag("rsi", k)}, rsi)')} as rsi_lag_{k}, {r4(f'rsi - coalesce({lag("rsi", k)}, rsi)')} as rsi_delta_{k}" for k in (3, 5, 10)) + " from rsi"),
    ),
    "w25_prior_average": (
        _bars(ind.prior_average),
        sql("bars", f"with a as (select asset_id, d, v, {mean_sql('v', 20, 1)} as p from bars) select asset_id, d, {r4('p')} as prior_volume, {r4('v / p')} as volume_ratio from a where p is not null"),
    ),
    "w28_sequences": (
        lambda s, d: ind.sequences(panel.bars(s, d)).select("asset_id", "d", ind.F.array_join(ind.F.transform("closes", lambda x: x.cast("string")), ",").alias("closes")),
        sql("bars", f"select asset_id, d, array_to_string(x, ',') as closes from (select asset_id, d, list(c) over ({W} rows between 19 preceding and current row) as x from bars) where len(x) = 20"),
    ),
    "w6_ema": (_bars(ind.ema_latest), _fold("select asset_id, " + ", ".join(f"{r4(_ema(p))} as ema_{p}" for p in ind.SMA_PERIODS) + " from cl")),
    "w3_macd": (_bars(ind.macd_latest), _fold(f"select * from (select asset_id, {r4(_ema(12) + ' - ' + _ema(26))} as macd from cl) where macd is not null")),
    "w1_rsi_wilder": (
        _bars(ind.wilder_rsi_latest),
        _fold(
            f""", df as (select asset_id, list_transform(generate_series(2, len(x)), lambda i: x[i] - x[i - 1]) as y from cl where len(x) >= 15),
            gs as (select asset_id, {_wilder('')} as g, {_wilder('-')} as s from df)
            select asset_id, {r4('case when g + s > 0 then 100 * g / (g + s) else 50.0::double end')} as rsi from gs"""
        ),
    ),
    "w9_adx": (_bars(ind.adx_latest), adx_sql("select * from adx")),
    "g1_ma_cross": (lambda s, d: sig.fired(panel.bars(s, d), "GOLDEN_CROSS", "DEATH_CROSS"), signal_sql("GOLDEN_CROSS", "DEATH_CROSS")),
    "g2_ma_align": (lambda s, d: sig.fired(panel.bars(s, d), "MA_BULL_ALIGN", "MA_BEAR_ALIGN"), signal_sql("MA_BULL_ALIGN", "MA_BEAR_ALIGN")),
    "g3_bb_squeeze": (lambda s, d: sig.fired(panel.bars(s, d), "BB_SQUEEZE"), signal_sql("BB_SQUEEZE")),
    "g4_bb_breakout": (lambda s, d: sig.fired(panel.bars(s, d), "BB_BREAKOUT_UP", "BB_BREAKOUT_DOWN"), signal_sql("BB_BREAKOUT_UP", "BB_BREAKOUT_DOWN")),
    "g5_bb_rsi": (lambda s, d: sig.fired(panel.bars(s, d), "BB_RSI_OVERBOUGHT", "BB_RSI_OVERSOLD"), signal_sql("BB_RSI_OVERBOUGHT", "BB_RSI_OVERSOLD")),
    "g6_volume_spike": (lambda s, d: sig.fired(panel.bars(s, d), "VOLUME_SPIKE"), signal_sql("VOLUME_SPIKE")),
    "g7_volume_divergence": (lambda s, d: sig.fired(panel.bars(s, d), "VOLUME_DIVERGENCE_BEAR", "VOLUME_DIVERGENCE_BULL"), signal_sql("VOLUME_DIVERGENCE_BEAR", "VOLUME_DIVERGENCE_BULL")),
    "g8_momentum": (lambda s, d: sig.fired(panel.bars(s, d), "MOMENTUM_UP_5D", "MOMENTUM_DOWN_5D"), signal_sql("MOMENTUM_UP_5D", "MOMENTUM_DOWN_5D")),
    "g9_oversold_combination": (lambda s, d: sig.fired(panel.bars(s, d), "OVERSOLD_COMBINATION"), signal_sql("OVERSOLD_COMBINATION")),
    "g11_all_signals": (lambda s, d: sig.fired(panel.bars(s, d)), signal_sql()),
}
