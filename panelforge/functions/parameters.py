"""Parameters of screeners, boards and backtests, with defaults, clamps and checks."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZONS = (3, 7, 30)


def clamped(text: object, low: float, high: float, default: float, whole: bool = True) -> float:
    """A number from a text, within bounds; the default where it is none."""
    try:
        value = float(str(text).strip())
    except ValueError:
        return default
    if value != value:
        return default
    value = min(high, max(low, value))
    return int(value) if whole else value


def flag(text: object, default: bool | None = None) -> bool | None:
    return {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}.get(str(text).strip().lower(), default)


@dataclass(frozen=True)
class Screen:
    """Parameters of a screener."""

    limit: int = 20
    high: float = 70.0
    low: float = 30.0
    ratio: float = 1.5
    search: str = ""
    suggested: bool | None = None

    @staticmethod
    def of(given: dict) -> Screen:
        return Screen(
            int(clamped(given.get("limit"), 1, 100, 20)),
            clamped(given.get("high"), 50, 100, 70.0, False),
            clamped(given.get("low"), 0, 50, 30.0, False),
            clamped(given.get("ratio"), 1, 20, 1.5, False),
            str(given.get("search") or "").strip(),
            flag(given.get("suggested")),
        )


def aligned_horizon(metric: str, horizon: int) -> int:
    """``up_prob_Nd`` speaks of N days, whatever horizon is asked for."""
    found = re.fullmatch(r"up_prob_(\d+)d", metric)
    return int(found[1]) if found and int(found[1]) in HORIZONS else horizon


@dataclass(frozen=True)
class Backtest:
    """Parameters of a run; ``checked`` lists what is wrong with them."""

    start: date
    end: date
    capital: float = 100_000.0
    slots: int = 5
    fraction: float = 0.5
    horizon: int = 7
    metric: str = "bottom"
    top: int = 3

    def checked(self) -> list[str]:
        wrong = []
        if self.start >= self.end:
            wrong.append("start is not before end")
        if not self.capital > 0:
            wrong.append("capital is not above 0")
        if not 1 <= self.slots <= 100:
            wrong.append("slots are not within 1 and 100")
        if not 0 < self.fraction <= 1:
            wrong.append("fraction is not within 0 and 1")
        if self.horizon not in HORIZONS:
            wrong.append("horizon is none of 3, 7, 30")
        if self.top < 1:
            wrong.append("top is not above 0")
        return wrong

    def aligned(self) -> Backtest:
        return Backtest(self.start, self.end, self.capital, self.slots, self.fraction, aligned_horizon(self.metric, self.horizon), self.metric, self.top)


def backtest_errors() -> Column:
    """What is wrong with the runs of a table (start, end, capital, slots, fraction, horizon, top), as ``Backtest.checked`` says.

    A null is wrong wherever a value is needed.
    """
    rules = {
        "start is not before end": F.col("start") < F.col("end"),
        "capital is not above 0": F.col("capital") > 0,
        "slots are not within 1 and 100": F.col("slots").between(1, 100),
        "fraction is not within 0 and 1": (F.col("fraction") > 0) & (F.col("fraction") <= 1),
        f"horizon is none of {', '.join(map(str, HORIZONS))}": F.col("horizon").isin(*HORIZONS),
        "top is not above 0": F.col("top") >= 1,
    }
    found = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(None)).otherwise(F.lit(text)) for text, rule in rules.items()])
    return F.filter(found, lambda text: text.isNotNull())
