"""Signals: one row for every rule that fires.

All inputs of all rules are columns of one projection over the same window partitioning; the rules are then
stacked, so the panel is read and sorted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_asset, run_mean, run_spread, running
from .indicators import lagged, obv_column, rsi_columns


def inputs(bars: DataFrame) -> DataFrame:
    """Bars with what the rules look at."""
    x = running(rsi_columns(bars).withColumn("signed", obv_column()), "c", "v", squares=("c",))
    x = x.withColumns(
        {
            "row": F.row_number().over(by_asset()),
            "obv": F.sum("signed").over(by_asset()),
            **{f"ma{p}": run_mean("c", p) for p in (5, 10, 20, 60)},
            "dev": run_spread("c", 20),
            "prior": run_mean("v", 20, end=1),
            "c5": lagged("c", 5),
        }
    )
    x = x.withColumns({"upper": F.col("ma20") + 2 * F.col("dev"), "lower": F.col("ma20") - 2 * F.col("dev")})
    return x.withColumns({"ma5_1": F.lag("ma5").over(by_asset()), "ma20_1": F.lag("ma20").over(by_asset()), "obv5": F.lag("obv", 5).over(by_asset())})


#: Name, condition: SQL over the columns of ``inputs``; each is false on null.
RULES = {
    "GOLDEN_CROSS": "row >= 62 and ma5_1 <= ma20_1 and ma5 > ma20",
    "DEATH_CROSS": "row >= 62 and ma5_1 >= ma20_1 and ma5 < ma20",
    "MA_BULL_ALIGN": "row >= 62 and ma5 > ma10 and ma10 > ma20 and ma20 > ma60",
    "MA_BEAR_ALIGN": "row >= 62 and ma5 < ma10 and ma10 < ma20 and ma20 < ma60",
    "BB_SQUEEZE": "row >= 34 and upper - lower < ma20 / 20",
    "BB_BREAKOUT_UP": "row >= 34 and c > upper",
    "BB_BREAKOUT_DOWN": "row >= 34 and c < lower",
    "BB_RSI_OVERBOUGHT": "row >= 34 and c * 100 >= 98 * upper and rsi > 70",
    "BB_RSI_OVERSOLD": "row >= 34 and c * 100 <= 102 * lower and rsi < 30",
    "VOLUME_SPIKE": "row >= 22 and v >= 2 * prior",
    "VOLUME_DIVERGENCE_BEAR": "row >= 22 and (c - c5) * 100 >= 3 * c5 and obv < obv5",
    "VOLUME_DIVERGENCE_BULL": "row >= 22 and (c - c5) * 100 <= -3 * c5 and obv > obv5",
    "MOMENTUM_UP_5D": "row >= 22 and (c - c5) * 100 >= 5 * c5",
    "MOMENTUM_DOWN_5D": "row >= 22 and (c - c5) * 100 <= -5 * c5",
    "OVERSOLD_COMBINATION": "row >= 25 and rsi < 30 and c * 100 <= 102 * lower and v * 10 < 8 * prior",
}


def fired(bars: DataFrame, *names: str) -> DataFrame:
    """asset_id, d, signal_type for the named rules, or all."""
    chosen = names or tuple(RULES)
    flags = F.array(*[F.when(F.expr(RULES[n]), F.lit(n)) for n in chosen])
    hits = F.filter(flags, lambda s: s.isNotNull())
    return inputs(bars).select("asset_id", "d", F.explode(hits).alias("signal_type"))
