"""Candidates of runs of all strategies against a walk over the rows."""

from datetime import date

import numpy as np
import pytest

from panelforge.operators import picks as pk
from panelforge.operators import scoring as sc
from panelforge.plans.picks import COLUMNS

SCORES = "source string, horizon int, asset_id long, d date, up double, trade_score double, macro string"
DAYS = [date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1)]
PHASES = {date(2024, 1, 1): "RECESSION"}


def half_up(x):
    return np.floor(x * 10000 + 0.5) / 10000


def plain(runs, scores, factors, allowed=None):
    out = []
    for run, strategy, mode, metric, scope, source, horizon, least_up, least, top, slots, macro in runs:
        for d in DAYS:
            found = []
            for a in range(12):
                if allowed is not None and (a, d) not in allowed:
                    continue
                if strategy == "bottom":
                    up, trade = None, factors.get((a, d))
                elif mode == "trade_score" and scope == "combined":
                    here = [scores.get((s, horizon, a, d), (None, None)) for s in ("heuristic", "boosted")]
                    exact = [[x[k] for x in here if x[k] is not None] for k in (0, 1)]
                    up, trade = (sum(round(v * 10000) for v in e) / (len(e) * 10000.0) if e else None for e in exact)
                else:
                    up, trade = scores.get((source, horizon, a, d), (None, None))
                value = trade if strategy == "bottom" or mode == "trade_score" or metric == "trade_score" else up
                if strategy == "prediction" and (up is None or up < least_up):
                    continue
                if (strategy == "bottom" or mode == "trade_score") and (trade is None or trade < least):
                    continue
                if value is not None:
                    found.append((-value, a, up))
            cut = slots if strategy == "prediction" and mode == "trade_score" else top
            found = sorted(found)[: max(cut, 0)]
            phase = PHASES.get(d.replace(day=1))
            times = lambda up: 1.0 if not macro or strategy == "bottom" or phase is None else (lambda b, s, f: b + s * max(0.0, up - f))(*sc.PHASE_MULTIPLIER[phase])
            again = sorted((-half_up(-v * times(up)), a) for v, a, up in found)
            out += [(run, d, k + 1, a, -v) for k, (v, a) in enumerate(again)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_every_strategy_mode_and_scope(spark, seed):
    rng = np.random.default_rng(seed)
    number = lambda: None if rng.random() < 0.15 else float(rng.integers(0, 21)) / 20
    scores = {(s, h, a, d): (number(), number()) for s in ("heuristic", "boosted") for h in (3, 7) for a in range(12) for d in DAYS if rng.random() < 0.8}
    factors = {(a, d): number() for a in range(12) for d in DAYS if rng.random() < 0.8}
    runs = []
    for strategy in ("bottom", "prediction"):
        for mode in ("top_n", "trade_score"):
            for metric in ("up", "trade_score"):
                for scope in ("independent", "combined"):
                    runs.append((len(runs), strategy, mode, metric, scope, ("heuristic", "boosted")[len(runs) % 2], (3, 7)[len(runs) // 2 % 2], 0.3, 0.4, 3, 4, len(runs) % 3 > 0))
    wrong = [(90, "other", "top_n", "up", "independent", "heuristic", 7, 0.0, 0.0, 3, 3, False), (91, "prediction", "other", "up", "independent", "heuristic", 7, 0.0, 0.0, 3, 3, False)]
    wrong += [(92, "prediction", "top_n", "up", "independent", "none", 7, 0.0, 0.0, 3, 3, False), (93, "prediction", "top_n", "up", "independent", "heuristic", 7, 0.0, 0.0, 0, 3, False)]
    table = spark.createDataFrame([(*k, *v, "x") for k, v in scores.items()], SCORES)
    bottoms = spark.createDataFrame([(*k, v) for k, v in factors.items()], "asset_id long, d date, bottom double")
    every = table.drop("macro").unionByName(pk.combined(table)).unionByName(pk.factor_rows(bottoms))
    phases = spark.createDataFrame(list(PHASES.items()), "month date, phase string")
    asked = spark.createDataFrame(runs + wrong, COLUMNS)
    want = plain(runs, scores, factors)
    for most in (None, 4):
        got = sorted(map(tuple, pk.picked(asked, every, phases, most).collect()))
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert np.allclose([r[4] for r in got], [r[4] for r in want])
    allowed = {(a, d) for a in range(0, 12, 2) for d in DAYS[:2]}
    some = spark.createDataFrame(sorted(allowed) * 2, "asset_id long, d date")
    got = sorted(tuple(r)[:4] for r in pk.picked(asked, every, phases, eligible=some).collect())
    assert got == [r[:4] for r in plain(runs, scores, factors, allowed)]


def test_empty_tables(spark):
    scores = spark.createDataFrame([], SCORES.removesuffix(", macro string"))
    phases = spark.createDataFrame([], "month date, phase string")
    assert pk.picked(spark.createDataFrame([], COLUMNS), scores.unionByName(pk.combined(scores)), phases).count() == 0
