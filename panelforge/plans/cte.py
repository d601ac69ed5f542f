"""SQL of the derived panel, the same rules as ``sources.panel``."""

from __future__ import annotations

CTE = {
    "bars": """
  bars_li as (select l_suppkey as asset_id, cast(l_shipdate as date) as d, cast(round(l_extendedprice * 100) as bigint) as cents,
                     cast(l_quantity as bigint) as q from lineitem),
  bars_g as (select asset_id, d, cast(sum(cents % 801 - 400) as bigint) as step, cast(sum(q) as bigint) as v,
                    cast(max(cents % 97) as bigint) as up, cast(max(cents % 89) as bigint) as dn from bars_li group by asset_id, d),
  bars_w as (select asset_id, d, v, up, dn,
                    cast(greatest(20000 + sum(step) over (partition by asset_id order by d), 100) as bigint) as c from bars_g),
  bars as (select asset_id, d, c, c + up as h, greatest(c - dn, 1) as l, v from bars_w)""",
    "assets": """
  assets as (select s_suppkey as asset_id, s_name as symbol, n_name as country, r_name as market, s_suppkey % 17 <> 0 as active,
                    list_filter([case when s_suppkey % 3 = 0 then 'IDX_A' end, case when s_suppkey % 5 = 0 then 'IDX_B' end], lambda t: t is not null) as tags
             from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""",
    "calendar": """
  calendar as (select distinct d from bars)""",
    "membership": """
  member_months as (select distinct cast(date_trunc('month', d) as date) as trade_date from calendar),
  member_n as (select asset_id, trade_date, year(trade_date) * 12 + month(trade_date) + asset_id as n from assets, member_months),
  membership as (select 'IDX_A' as index_code, trade_date, asset_id, 1 + asset_id % 7 as weight from member_n where n % 3 = 0
                 union all select 'IDX_B', trade_date, asset_id, 1 + asset_id % 7 from member_n where n % 5 = 0)""",
    "fundamentals": """
  fund_g as (select l_suppkey as asset_id, cast(date_trunc('month', l_shipdate) as date) as report_date, cast(sum(cast(p_size as bigint)) as bigint) as s, count(*) as n
             from lineitem join part on l_partkey = p_partkey group by 1, 2),
  fundamentals as (select asset_id, report_date, report_date + cast(30 + asset_id % 20 as integer) as available_date,
                          case when s % 11 <> 0 then s % 97 + 3 end as pe, n % 13 + 1 as pb, s * 7 % 500 - 100 as roe_bp, 50 + asset_id % 50 as free_share from fund_g)""",
    "flows": """
  flow_g as (select l_suppkey as asset_id, cast(l_shipdate as date) as d,
                    cast(sum(case when l_linestatus = 'O' and l_quantity > 25 then cast(l_quantity as bigint) else 0 end) as bigint) as lg_buy,
                    cast(sum(case when l_linestatus <> 'O' and l_quantity > 25 then cast(l_quantity as bigint) else 0 end) as bigint) as lg_sell,
                    cast(sum(case when l_linestatus = 'O' and l_quantity <= 25 then cast(l_quantity as bigint) else 0 end) as bigint) as sm_buy,
                    cast(sum(case when l_linestatus <> 'O' and l_quantity <= 25 then cast(l_quantity as bigint) else 0 end) as bigint) as sm_sell,
                    cast(sum(cast(l_quantity as bigint) % 7 - 3) as bigint) as change from lineitem group by 1, 2),
  flows as (select asset_id, d, lg_buy, lg_sell, sm_buy, sm_sell, cast(1000 + sum(change) over (partition by asset_id order by d) as bigint) as balance from flow_g)""",
    "macro": """
  macro_g as (select cast(date_trunc('month', o_orderdate) as date) as date, count(*) as n, cast(sum(o_custkey % 10) as bigint) as k from orders group by 1),
  macro as (select date, case when (year(date) * 12 + month(date)) % 11 <> 0 then 45 + k % 11 end as pmi, 48 + n % 9 as non_pmi, k % 41 as cpi10,
                   200 + n % 150 as y10, 150 + k % 150 as y2 from macro_g)""",
    "news": """
  news as (select doc_id as article_id, date '1995-01-02' + cast(doc_id % 2499 as integer) as published, source, lang, 'doc/' || doc_id as url, text from documents)""",
}
NEEDS = {"calendar": ["bars"], "membership": ["bars", "calendar", "assets"]}


def sql(names: str, body: str) -> str:
    """``body`` (CTEs and a select, or a select) after the named parts of the panel."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    parts = ",".join(CTE[n] for n in order)
    body = body.strip()
    return f"with {parts}, {body[5:]}" if body.lower().startswith("with ") else f"with {parts}\n{body}"
