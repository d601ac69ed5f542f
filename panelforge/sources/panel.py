"""The panel of the analytics, derived from the driver's tables in integers.

Prices are integer ticks, so that sums are exact and independent of their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import indicators as ind

#: Every 17th asset is delisted; index snapshots are taken on the first of a month.
DELISTED = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that a partition of a shuffle gets at most, about; beyond the session's number of partitions there are more of them.
ROWS_EACH = 500_000
BARS = ("asset_id", "d", "c", "h", "l", "v")
FLOWS = ("lg_buy", "lg_sell", "sm_buy", "sm_sell", "balance")


def parts(spark: SparkSession, sf_dir: str) -> int | None:
    """How many partitions shuffles of the panel take so that a task's share stays the same, the session's number at least.

    None where a partition a core will do: the session's number may then be merged to fewer, as Spark merges by compressed
    bytes, of which rows of a day take few and their sorts many.
    """
    need = -(-table(spark, sf_dir, "lineitem").count() // ROWS_EACH)  # the count is read from the files' footers
    return max(need, int(spark.conf.get("spark.sql.shuffle.partitions"))) if need > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, key: str, number: int | None) -> DataFrame:
    """``df`` dealt by ``key`` to ``number`` partitions, or to the session's number."""
    return df.repartition(key) if number is None else df.repartition(number, key)


def daily(spark: SparkSession, sf_dir: str, flow: bool = True) -> DataFrame:
    """``bars`` and, unless ``flow`` is false, ``flows`` in one row an asset and day, as both are sums of the same lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("asset_id"),
        F.to_date("l_shipdate").alias("d"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("q"),
        *([(F.col("l_linestatus") == "O").alias("buy")] if flow else []),
        (F.col("l_quantity") > 25).alias("large"),
    )
    buy, large = F.col("buy"), F.col("large")
    pick = lambda cond: F.sum(F.when(cond, F.col("q")).otherwise(0))
    sides = {"lg_buy": buy & large, "lg_sell": ~buy & large, "sm_buy": buy & ~large, "sm_sell": ~buy & ~large} if flow else {}
    # dealt by asset at once: hardly any rows share an asset and day, and the sums and the walk need one shuffle so
    days = dealt(lines, "asset_id", parts(spark, sf_dir)).groupBy("asset_id", "d").agg(
        F.sum(F.col("cents") % 801 - 400).alias("step"),
        F.sum("q").alias("v"),
        F.max(F.col("cents") % 97).alias("up"),
        F.max(F.col("cents") % 89).alias("dn"),
        *[pick(side).alias(name) for name, side in sides.items()],
        F.sum(F.col("q") % 7 - 3).alias("change"),
    )
    by = Window.partitionBy("asset_id").orderBy("d")
    days = days.withColumns({"c": F.greatest(F.sum("step").over(by) + 20000, F.lit(100)), "balance": F.sum("change").over(by) + 1000})
    return days.select("asset_id", "d", "c", (F.col("c") + F.col("up")).alias("h"), F.greatest(F.col("c") - F.col("dn"), F.lit(1)).alias("l"), "v", *(FLOWS if flow else ()))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, d, c, h, l, v: one bar an asset and day."""
    return daily(spark, sf_dir, flow=False)


_shared: dict[tuple[str, str], DataFrame] = {}


def shared_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of ``shared_panel``."""
    return shared_panel(spark, sf_dir).select(*BARS)


def shared_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bars`` with main_force_5d and margin_change_5d of the day's flows, kept in memory and on disk for the branches of queries.

    What a lost executor held is worked out again.  One panel is kept at a time: that of another folder, or session, is
    released first.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        release()
        _shared[key] = ind.flow_columns(daily(spark, sf_dir)).select(*BARS, "main_force_5d", "margin_change_5d").persist()
    return _shared[key]


def release() -> None:
    """Let go of the panel that is kept; queries on it read the tables again."""
    for (app, _), kept in _shared.items():
        if app == kept.sparkSession.sparkContext.applicationId:
            kept.unpersist()
    _shared.clear()


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, symbol, country, market, active and tags."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    tags = F.filter(
        F.array(F.when(key % 3 == 0, "IDX_A"), F.when(key % 5 == 0, "IDX_B")), lambda t: t.isNotNull()
    )
    return joined.select(
        key.alias("asset_id"), F.col("s_name").alias("symbol"), F.col("n_name").alias("country"), F.col("r_name").alias("market"),
        (key % DELISTED != 0).alias("active"), tags.alias("tags"),
    )


def calendar(panel: DataFrame) -> DataFrame:
    """The trading days."""
    return panel.select("d").distinct()


def membership(days: DataFrame, universe: DataFrame) -> DataFrame:
    """index_code, trade_date, asset_id, weight: snapshots on the first of every month that trades."""
    months = days.select(F.trunc("d", "MM").alias("trade_date")).distinct()
    n = F.year("trade_date") * 12 + F.month("trade_date") + F.col("asset_id")
    codes = F.filter(F.array(F.when(n % 3 == 0, "IDX_A"), F.when(n % 5 == 0, "IDX_B")), lambda t: t.isNotNull())
    each = universe.select("asset_id").crossJoin(months)  # months are a few hundred
    return each.select(F.explode(codes).alias("index_code"), "trade_date", "asset_id", (1 + F.col("asset_id") % 7).alias("weight"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, report_date, available_date, pe, pb, roe_bp, free_share by month; some pe are null."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.trunc(F.to_date("l_shipdate"), "MM").alias("report_date"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    monthly = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("asset_id"), "report_date")
    monthly = monthly.agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    return monthly.select(
        "asset_id",
        "report_date",
        F.date_add("report_date", (30 + F.col("asset_id") % 20).cast("int")).alias("available_date"),
        F.when(F.col("s") % 11 != 0, F.col("s") % 97 + 3).alias("pe"),
        (F.col("n") % 13 + 1).alias("pb"),
        (F.col("s") * 7 % 500 - 100).alias("roe_bp"),
        (50 + F.col("asset_id") % 50).alias("free_share"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, d, lg_buy, lg_sell, sm_buy, sm_sell, balance: traded quantities by size, and a running balance."""
    return daily(spark, sf_dir).select("asset_id", "d", *FLOWS)


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, pmi, non_pmi, cpi10 (tenths of a percent), y10, y2 (basis points) by month; pmi is null in every eleventh."""
    monthly = table(spark, sf_dir, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("date"))
    monthly = monthly.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_custkey") % 10).alias("k"))
    m = F.year("date") * 12 + F.month("date")
    return monthly.select(
        "date",
        F.when(m % 11 != 0, 45 + F.col("k") % 11).alias("pmi"),
        (48 + F.col("n") % 9).alias("non_pmi"),
        (F.col("k") % 41).alias("cpi10"),
        (200 + F.col("n") % 150).alias("y10"),
        (150 + F.col("k") % 150).alias("y2"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, published, source, lang, url, text."""
    docs = table(spark, sf_dir, "documents")
    published = F.date_add(F.to_date(F.lit("1995-01-02")), (F.col("doc_id") % 2499).cast("int"))
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("article_id"), published.alias("published"), "source", "lang", url.alias("url"), "text")
