"""Upkeep of stored tables: repaired contexts, predictions worked out on a miss, model versions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parameters import backtest_errors
from ..operators import contexts as ctx
from ..operators import serving
from ..sources import panel
from ..sources.scratch import scratch_path
from .cte import sql
from .scores import HEURISTIC, predictions


def _macro_now(s, d):
    """The macro table after months came: those without an index have 50, every seventh has another, every thirteenth none."""
    m = F.year("date") * 12 + F.month("date")
    pmi = F.when(m % 13 == 0, F.lit(None)).when(m % 7 == 0, F.col("pmi") + 4).otherwise(F.coalesce("pmi", F.lit(50)))
    return panel.macro(s, d).withColumn("pmi", pmi.cast("long"))


def _changed(s, d):
    old, new = panel.macro(s, d).select("date", "pmi"), _macro_now(s, d).select("date", F.col("pmi").alias("now"))
    return old.join(new, "date").where(~F.col("pmi").eqNullSafe(F.col("now"))).select("date")


def context_patch(s, d):
    """The intervals that those months touch, and no others."""
    return ctx.patch(ctx.history(panel.macro(s, d)), _macro_now(s, d), _changed(s, d))


def repaired_contexts(s, d):
    return ctx.applied(ctx.history(panel.macro(s, d)), context_patch(s, d))


NOW = """mo as (select * replace (case when (year(date) * 12 + month(date)) % 13 = 0 then null when (year(date) * 12 + month(date)) % 7 = 0 then pmi + 4 else coalesce(pmi, 50) end as pmi) from macro)"""


def _history(name: str, macro: str) -> str:
    return f"""{name} as (select date as starts_at, following - 1 as ends_at, case when pmi < 50 and slope < 0 then 'RECESSION' when pmi < 50 and cpi10 / 10.0::double > 2.5 then 'STAGFLATION'
  when pmi >= 52 and non_pmi >= 53 then 'OVERHEAT' else 'RECOVERY' end as phase, following is null as is_active
  from (select *, pmi - lag(pmi) over (order by date) as slope, lead(date) over (order by date) as following from {macro} where pmi is not null))"""


PREDICTION = T.StructType(
    [T.StructField(n, k) for n, k in (("asset_id", T.LongType()), ("d", T.DateType()), ("horizon", T.IntegerType()), ("up", T.DoubleType()), ("flat", T.DoubleType()), ("down", T.DoubleType()), ("label", T.StringType()))]
)
KEYS = ["asset_id", "d", "horizon"]


def served_predictions(s, d):
    """Predictions for each asset's last day at three horizons: those of even assets at seven days are stored, the others missing."""
    wanted = panel.shared_bars(s, d).groupBy("asset_id").agg(F.max("d").alias("d")).select("asset_id", "d", F.explode(F.array(*map(F.lit, (3, 7, 30)))).alias("horizon"))
    folder = scratch_path(s, "predictions")

    def compute(missing):
        days = missing.select("d").distinct()
        return predictions(s, d, days).join(missing, KEYS, "left_semi").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTION.fields])

    serving.read_through(wanted.where("asset_id % 2 = 0 and horizon = 7"), folder, KEYS, PREDICTION, compute)
    return serving.read_through(wanted, folder, KEYS, PREDICTION, compute)


def _registrations(s, d):
    """Registrations from the parts: a family a brand's last digit, versions that are registered again, some of them failed."""
    p = panel.table(s, d, "part")
    return p.select(
        F.concat(F.lit("family-"), (F.col("p_partkey") % 5).cast("string")).alias("family"),
        F.concat(F.lit("v"), (F.col("p_partkey") % 37).cast("string")).alias("version"),
        (F.col("p_partkey") * 7919 % 10007).cast("long").alias("registered_at"),
        F.when(F.col("p_size") % 6 == 0, "FAILED").otherwise("READY").alias("status"),
        (F.col("p_size") / 100.0).alias("accuracy"),
    )


def registered(s, d):
    """Two writers append the registrations, each its half; the registry is what they make together."""
    folder = scratch_path(s, "registry")
    rows = _registrations(s, d)
    for part in (1, 0):
        serving.append(rows.where(F.pmod("registered_at", F.lit(2)) == part), folder)
    return serving.registry(serving.stored(s, folder, serving.REGISTRATION))


def checked_runs(s, d):
    """Runs as the orders would ask for them, with what is wrong with each."""
    o, key = panel.table(s, d, "orders"), F.col("o_orderkey")
    runs = o.select(
        key.alias("run_id"),
        F.to_date("o_orderdate").alias("start"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 5 - 1).cast("int")).alias("end"),
        (F.col("o_custkey") % 50 - 2).alias("capital"),
        (key % 104).alias("slots"),
        ((F.col("o_custkey") % 12) / 10.0).alias("fraction"),
        F.element_at(F.array(*map(F.lit, (3, 7, 30, 5))), (key % 4 + 1).cast("int")).alias("horizon"),
        (F.col("o_custkey") % 7).alias("top"),
    )
    return runs.select("run_id", F.array_join(backtest_errors(), "; ").alias("errors"))


QUERIES = {
    "b15_parameter_checks": (
        checked_runs,
        "with r as (select o_orderkey as run_id, o_custkey % 5 - 1 as days, o_custkey % 50 - 2 as capital, o_orderkey % 104 as slots, (o_custkey % 12) / 10.0::double as fraction, [3, 7, 30, 5][o_orderkey % 4 + 1] as horizon, o_custkey % 7 as top from orders) "
        "select run_id, array_to_string(list_filter([case when days <= 0 then 'start is not before end' end, case when capital <= 0 then 'capital is not above 0' end, case when slots not between 1 and 100 then 'slots are not within 1 and 100' end, "
        "case when not (fraction > 0 and fraction <= 1) then 'fraction is not within 0 and 1' end, case when horizon not in (3, 7, 30) then 'horizon is none of 3, 7, 30' end, case when top < 1 then 'top is not above 0' end], lambda x: x is not null), '; ') as errors from r",
    ),
    "m32_context_patch": (
        context_patch,
        sql(
            "macro",
            f"with {NOW}, {_history('old', 'macro')}, {_history('new', 'mo')} select coalesce(new.starts_at, old.starts_at) as starts_at, case when new.starts_at is null then old.ends_at else new.ends_at end as ends_at, case when new.starts_at is null then old.phase else new.phase end as phase, "
            "case when new.starts_at is null then old.is_active else new.is_active end as is_active, case when new.starts_at is null then 'delete' else 'upsert' end as change from old full join new on old.starts_at = new.starts_at "
            "where old.starts_at is distinct from new.starts_at or old.ends_at is distinct from new.ends_at or old.phase is distinct from new.phase or old.is_active is distinct from new.is_active",
        ),
    ),
    "m32_repaired_contexts": (repaired_contexts, sql("macro", f"with {NOW}, {_history('new', 'mo')} select * from new")),
    "qf_served_predictions": (
        served_predictions,
        sql("bars fundamentals flows macro news", f"{HEURISTIC}, want as (select asset_id, max(d) as d from bars group by 1) select hq.asset_id, hq.d, horizon, up, flat, down, label from hq join want on want.asset_id = hq.asset_id and want.d = hq.d"),
    ),
    "m30_registry": (
        registered,
        "with r as (select 'family-' || (p_partkey % 5) as family, 'v' || (p_partkey % 37) as version, cast(p_partkey * 7919 % 10007 as bigint) as registered_at, case when p_size % 6 = 0 then 'FAILED' else 'READY' end as status, p_size / 100.0::double as accuracy from part), "
        "n as (select * from r qualify row_number() over (partition by family, version order by registered_at desc, status desc, accuracy desc) = 1), b as (select family, arg_max(version, (registered_at, version)) as active from n where status = 'READY' group by 1) "
        "select family, version, registered_at, status, accuracy, coalesce(version = active, false) as is_active from n left join b using (family)",
    ),
}
