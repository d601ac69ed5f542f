"""The validation report by asset against a walk over the days."""

from collections import defaultdict
from datetime import date, timedelta

import numpy as np

from panelforge.operators import quality as ql


def day(k):
    return date(2024, 1, 1) + timedelta(int(k))


def test_ranges_of_missing_days(spark):
    rng = np.random.default_rng(7)
    days = sorted({day(k) for k in rng.integers(0, 60, 40)})
    listed = {1: None, 2: day(-5), 3: day(17), 4: days[-1], 5: day(90), 6: day(30)}
    have = {(a, d) for a in (1, 2, 3, 4, 9) for d in days if rng.random() < 0.6} | {(1, day(99))}
    assets = spark.createDataFrame(list(listed.items()) + [(2, day(3)), (None, day(1))], "asset_id long, list_date date")
    bars = spark.createDataFrame(sorted(have) * 2 + [(None, days[0]), (1, None)], "asset_id long, d date")
    calendar = spark.createDataFrame([(d,) for d in days * 2] + [(None,)], "d date")
    want = []
    for a, start in listed.items():
        run = []
        for d in [*(x for x in days if start is None or x >= start), None]:
            if d is not None and (a, d) not in have:
                run.append(d)
            elif run:
                want.append((a, run[0], run[-1], len(run)))
                run = []
    assert sorted(map(tuple, ql.ranges(assets, bars, calendar).collect())) == sorted(want)
    assert ql.ranges(assets, bars, calendar.limit(0)).count() == 0
    assert ql.ranges(assets.limit(0), bars, calendar).count() == 0


def test_related_rows_and_fields(spark):
    rng = np.random.default_rng(8)
    keys = [(a, day(k)) for a in range(4) for k in range(12)]
    pick = lambda: [k for k in keys if rng.random() < 0.6]
    bars, x, y = pick(), pick(), pick()
    table = lambda rows: spark.createDataFrame(rows * 2 + [(None, day(0)), (1, None)], "asset_id long, d date")
    want = defaultdict(list)
    for a, d in bars:
        for name, rows in (("x", x), ("y", y)):
            if (a, d) not in rows:
                want[a, "missing_related", name, ""].append(d)
    got = ql.missing_related(table(bars), {"x": table(x), "y": table(y)})
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == {k: (len(v), min(v), max(v)) for k, v in want.items()}
    rows = [(1, day(0), None, 0.5), (1, day(1), 0.5, 0.5), (1, day(1), 0.5, 0.5), (2, day(2), 1.0, None), (None, day(2), None, None)]
    got = ql.fields(spark.createDataFrame(rows, "asset_id long, d date, p double, q double"), "t", nulls=["p"], neutral=["p", "q"])
    assert sorted(map(tuple, got.collect())) == sorted([
        (1, "null_field", "t", "p", 1, day(0), day(0)), (1, "neutral_default", "t", "p", 1, day(1), day(1)), (1, "neutral_default", "t", "q", 2, day(0), day(1)),
    ])
