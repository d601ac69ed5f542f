"""Technical indicators over bars (asset_id, d, c, h, l, v); frames are rows of one asset.

Windows partition by asset, so all of them share one shuffle and one sort.  Recursive smoothing (EMA, Wilder)
is a fold over an asset's closes in order, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_asset, four, mean, ratio, running, spread, trailed, trailing

SMA_PERIODS = (5, 10, 20, 50, 100, 200)
FIB_LEVELS = (0.236, 0.382, 0.5, 0.618, 0.786)


def lagged(x: str, n: int) -> Column:
    return F.lag(x, n).over(by_asset())


def sma(bars: DataFrame) -> DataFrame:
    """Simple averages; null until a period is full."""
    return bars.select("asset_id", "d", *[four(mean("c", p)).alias(f"sma_{p}") for p in SMA_PERIODS])


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Middle band and both bands at ``width`` population deviations."""
    out = bars.select("asset_id", "d", "c", mean("c", n).alias("mid"), spread("c", n).alias("dev"))
    out = out.where(F.col("mid").isNotNull())
    return out.select("asset_id", "d", "c", four(F.col("mid")).alias("middle"), four(F.col("mid") + width * F.col("dev")).alias("upper"), four(F.col("mid") - width * F.col("dev")).alias("lower"))


def rsi_columns(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds rsi from rolling means of gains and losses; 50 where the mean loss is 0 or rows are few."""
    diff = bars.withColumn("diff", F.col("c") - lagged("c", 1))
    diff = running(diff.withColumns({"gain": F.greatest("diff", F.lit(0)), "loss": F.greatest(-F.col("diff"), F.lit(0))}), "diff", "gain", "loss")
    sums = {"gains": trailed("_s_gain", n), "losses": trailed("_s_loss", n), "full": trailed("_n_diff", n) == n}
    rsi = F.when(F.col("full") & (F.col("losses") > 0), 100 - 100 / (1 + F.col("gains") / F.col("losses").cast("double"))).otherwise(F.lit(50.0))
    return diff.withColumns(sums).select(*bars.columns, rsi.alias("rsi"))


def stochastic(bars: DataFrame, n: int = 14, k: int = 3) -> DataFrame:
    """Slow %K and %D: means of ``k`` of the raw position in the range of ``n`` rows."""
    low, high = F.min("l").over(trailing(n)), F.max("h").over(trailing(n))
    raw = bars.withColumn("row", F.row_number().over(by_asset())).withColumns({"lo": low, "hi": high})
    # in units of 1e-4, so that sums are exact
    raw = raw.withColumn("fast", F.when(F.col("row") >= n, F.when(F.col("hi") > F.col("lo"), F.floor((F.col("c") - F.col("lo")) * 1000000.0 / (F.col("hi") - F.col("lo")) + 0.5)).otherwise(F.lit(0))))
    raw = raw.withColumn("slow3", F.when(F.count("fast").over(trailing(k)) == k, F.sum("fast").over(trailing(k))))
    raw = raw.withColumn("d9", F.when(F.count("slow3").over(trailing(k)) == k, F.sum("slow3").over(trailing(k))))
    return raw.where("d9 is not null").select("asset_id", "d", four(F.col("slow3") / 30000.0).alias("slow_k"), four(F.col("d9") / 90000.0).alias("slow_d"))


def changes(bars: DataFrame) -> DataFrame:
    """Relative changes over 1, 3, 5, 10 and 20 rows, and the five-row difference."""
    returns = [four(ratio(F.col("c") - lagged("c", n), lagged("c", n))).alias(f"ret_{n}") for n in (1, 3, 5, 10, 20)]
    return bars.select("asset_id", "d", *returns, (F.col("c") - lagged("c", 5)).alias("diff_5"))


def obv_column() -> Column:
    """Signed volume summed from an asset's first bar, whose volume starts it."""
    prev = F.lag("c").over(by_asset())
    return F.when(prev.isNull() | (F.col("c") > prev), F.col("v")).when(F.col("c") < prev, -F.col("v")).otherwise(F.lit(0))


def obv(bars: DataFrame) -> DataFrame:
    signed = bars.withColumn("signed", obv_column())
    return signed.select("asset_id", "d", F.sum("signed").over(by_asset()).cast("long").alias("obv"))


def fibonacci(bars: DataFrame, n: int = 60) -> DataFrame:
    """Levels between the low and the high of the last ``n`` rows; none where they are equal."""
    out = bars.select("asset_id", "d", F.min("l").over(trailing(n)).alias("lo"), F.max("h").over(trailing(n)).alias("hi"), F.row_number().over(by_asset()).alias("row"))
    levels = [four(F.col("hi") - (F.col("hi") - F.col("lo")) * x).alias(f"fib_{int(x * 1000)}") for x in FIB_LEVELS]
    return out.where(f"row >= {n} and hi > lo").select("asset_id", "d", *levels)


def momentum(bars: DataFrame) -> DataFrame:
    cols = [four(ratio(F.col("c") - lagged("c", n), lagged("c", n))).alias(f"mom_{n}d") for n in (5, 10, 20)]
    return bars.select("asset_id", "d", *cols).where("mom_5d is not null")


def flow_columns(flows: DataFrame) -> DataFrame:
    """Adds the five-row sum of large net purchases (from one row on), and the five-row change of the balance."""
    net = flows.withColumn("net", F.coalesce("lg_buy", F.lit(0)) - F.coalesce("lg_sell", F.lit(0)))
    return net.withColumns({"main_force_5d": F.sum("net").over(trailing(5)), "margin_change_5d": F.col("balance") - lagged("balance", 5)}).drop("net")


def flow_windows(flows: DataFrame) -> DataFrame:
    """asset_id, d and what ``flow_columns`` adds."""
    return flow_columns(flows).select("asset_id", "d", "main_force_5d", "margin_change_5d")


def relative_volume_columns(bars: DataFrame) -> DataFrame:
    """Adds rel_volume_5 and rel_volume_20."""

    def rel(n: int) -> Column:
        w = trailing(n)
        return four(F.coalesce(ratio(F.col("v") * F.count("v").over(w), F.sum("v").over(w)), F.lit(1.0)))

    return bars.withColumns({f"rel_volume_{n}": rel(n) for n in (5, 20)})


def relative_volume(bars: DataFrame) -> DataFrame:
    return relative_volume_columns(bars).select("asset_id", "d", "rel_volume_5", "rel_volume_20")


def volatility_column(bars: DataFrame, n: int = 5) -> DataFrame:
    """Adds volatility_bp, as ``realized_volatility`` has it."""
    bp = F.coalesce(F.floor(ratio((F.col("c") - lagged("c", 1)) * 10000, lagged("c", 1)) + 0.5), F.lit(0)).cast("long")
    out = bars.withColumn("_bp", bp)
    w = trailing(n)
    k, s, ss = F.count("_bp").over(w), F.sum("_bp").over(w), F.sum(F.col("_bp") * F.col("_bp")).over(w)
    return out.withColumn("volatility_bp", four(F.when(k >= 2, F.sqrt((k * ss - s * s).cast("double")) / k.cast("double")).otherwise(F.lit(0.0)))).drop("_bp")


def realized_volatility(bars: DataFrame, n: int = 5) -> DataFrame:
    """Population deviation of one-row returns in basis points; from two returns on, a first return counts 0."""
    return volatility_column(bars, n).select("asset_id", "d", "volatility_bp")


def lag_features(bars: DataFrame) -> DataFrame:
    """Lagged RSI (its own value where the lag is missing) and its change."""
    out = rsi_columns(bars)
    cols = []
    for k in (3, 5, 10):
        back = F.coalesce(lagged("rsi", k), F.col("rsi"))
        cols += [four(back).alias(f"rsi_lag_{k}"), four(F.col("rsi") - back).alias(f"rsi_delta_{k}")]
    return out.select("asset_id", "d", *cols)


def prior_average(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean volume of the ``n`` rows before the current one, and the ratio to it."""
    prior = mean("v", n, end=1)
    return bars.select("asset_id", "d", four(prior).alias("prior_volume"), four(F.col("v") / prior).alias("volume_ratio")).where("prior_volume is not null")


def sequences(bars: DataFrame, n: int = 20) -> DataFrame:
    """The closes of the ``n`` rows that end at each row."""
    seq = F.collect_list("c").over(trailing(n))
    return bars.select("asset_id", "d", seq.alias("closes")).where(F.size("closes") == n)


def _folded(bars: DataFrame, start: Column, merge, finish) -> DataFrame:
    """One value an asset from a fold over its closes in order."""
    ordered = bars.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("d", "c", "h", "l"))).alias("rows"))
    return ordered.select("asset_id", F.aggregate("rows", start, merge, finish).alias("x"))


def ema_fold(values: Column, n: int) -> Column:
    """EMA of an array of doubles: the mean of the first ``n``, then steps of 2 / (n + 1); null if shorter."""
    a = 2.0 / (n + 1)
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda s, x: s + x) / F.lit(float(n))
    tail = F.slice(values, F.lit(n + 1), F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(tail, seed, lambda e, x: e + (x - e) * a))


def closes(bars: DataFrame) -> DataFrame:
    """asset_id and its closes in order as doubles; an asset's history is bounded by its trading days."""
    rows = F.array_sort(F.collect_list(F.struct("d", "c")))
    return bars.groupBy("asset_id").agg(F.transform(rows, lambda r: r["c"].cast("double")).alias("closes"))


def ema_latest(bars: DataFrame, periods: tuple[int, ...] = SMA_PERIODS) -> DataFrame:
    return closes(bars).select("asset_id", *[four(ema_fold(F.col("closes"), p)).alias(f"ema_{p}") for p in periods])


def macd_latest(bars: DataFrame) -> DataFrame:
    """EMA 12 less EMA 26 of all closes."""
    both = closes(bars).select("asset_id", ema_fold(F.col("closes"), 12).alias("fast"), ema_fold(F.col("closes"), 26).alias("slow"))
    return both.select("asset_id", four(F.col("fast") - F.col("slow")).alias("macd")).where("macd is not null")


def wilder_rsi_latest(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's RSI: means of the first ``n`` gains and losses, then steps of 1 / n; null with fewer rows."""
    c = closes(bars)
    diffs = F.zip_with(F.slice("closes", F.lit(2), F.greatest(F.size("closes") - 1, F.lit(0))), F.slice("closes", F.lit(1), F.greatest(F.size("closes") - 1, F.lit(0))), lambda x, y: x - y)
    c = c.select("asset_id", diffs.alias("diffs")).where(F.size("diffs") >= n)

    def smooth(part) -> Column:
        seed = F.aggregate(F.slice("diffs", 1, n), F.lit(0.0), lambda s, x: s + part(x)) / F.lit(float(n))
        tail = F.slice("diffs", F.lit(n + 1), F.greatest(F.size("diffs") - n, F.lit(0)))
        return F.aggregate(tail, seed, lambda s, x: (s * (n - 1) + part(x)) / F.lit(float(n)))

    c = c.select("asset_id", smooth(lambda x: F.greatest(x, F.lit(0.0))).alias("g"), smooth(lambda x: F.greatest(-x, F.lit(0.0))).alias("s"))
    return c.select("asset_id", four(F.when(F.col("g") + F.col("s") > 0, 100 * F.col("g") / (F.col("g") + F.col("s"))).otherwise(F.lit(50.0))).alias("rsi"))


def adx_latest(bars: DataFrame, n: int = 14) -> DataFrame:
    """+DI, -DI and ADX by Wilder's sums, seeded with the first ``n`` rows; null with fewer than 2 n."""
    moved = bars.select(
        "asset_id",
        "d",
        (F.col("h") - lagged("h", 1)).alias("up"),
        (lagged("l", 1) - F.col("l")).alias("dn"),
        F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - lagged("c", 1)), F.abs(F.col("l") - lagged("c", 1))).alias("tr"),
        F.row_number().over(by_asset()).alias("row"),
    ).where("row > 1")
    plus = F.when((F.col("up") > F.col("dn")) & (F.col("up") > 0), F.col("up")).otherwise(0).cast("double")
    minus = F.when((F.col("dn") > F.col("up")) & (F.col("dn") > 0), F.col("dn")).otherwise(0).cast("double")
    rows = F.array_sort(F.collect_list(F.struct("d", plus.alias("p"), minus.alias("m"), F.col("tr").cast("double").alias("t"))))
    series = moved.groupBy("asset_id").agg(rows.alias("rows")).where(F.size("rows") >= 2 * n)
    zero = F.struct(F.lit(0).alias("k"), *[F.lit(0.0).alias(x) for x in ("p", "m", "t", "dx", "adx")])

    def step(a: Column, r: Column) -> Column:
        def summed(x: str) -> Column:
            return F.when(a["k"] < n, a[x] + r[x]).otherwise(a[x] - a[x] / F.lit(float(n)) + r[x])

        p, m, k = summed("p"), summed("m"), a["k"] + 1
        dx = F.when(p + m > 0, 100 * F.abs(p - m) / (p + m)).otherwise(F.lit(0.0))
        total = F.when((k >= n) & (k < 2 * n), a["dx"] + dx).otherwise(a["dx"])
        adx = F.when(k < 2 * n - 1, F.lit(0.0)).when(k == 2 * n - 1, total / F.lit(float(n))).otherwise((a["adx"] * (n - 1) + dx) / F.lit(float(n)))
        return F.struct(k.alias("k"), p.alias("p"), m.alias("m"), summed("t").alias("t"), total.alias("dx"), adx.alias("adx"))

    out = series.select("asset_id", F.aggregate("rows", zero, step).alias("a"))
    return out.select(
        "asset_id", four(100 * F.col("a.p") / F.col("a.t")).alias("plus_di"), four(100 * F.col("a.m") / F.col("a.t")).alias("minus_di"), four(F.col("a.adx")).alias("adx")
    )
