"""Versions of universes, worklists, and curves side by side, each against a plain recomputation."""

from datetime import date, timedelta

import numpy as np
import pytest

from panelforge.operators import comparison as cmp
from panelforge.operators import universe as un

SNAPSHOT = "index_code string, trade_date date, asset_id long, weight long"
VERSION = "index_code string, asset_id long, weight long, valid_from date, valid_to date"
DAY = date(2024, 1, 1)


def day(k):
    return DAY + timedelta(k)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_versions(snaps):
    """Versions of {(index, day): {asset: weight}} by walking the days."""
    out = []
    for index in {i for i, _ in snaps}:
        days = sorted(d for i, d in snaps if i == index)
        for asset in {a for i, d in snaps if i == index for a in snaps[i, d]}:
            span = None
            for d in days:
                here = snaps[index, d]
                if span and (asset not in here or here[asset] != span[0]):
                    out.append((index, asset, *span, d - timedelta(1)))
                    span = None
                if asset in here and span is None:
                    span = (here[asset], d)
            if span:
                out.append((index, asset, *span, None))
    return sorted(out, key=str)


def test_snapshots_one_by_one_equal_the_whole_history(spark):
    rng = np.random.default_rng(5)
    snaps, stored = {}, spark.createDataFrame([], VERSION)
    for k in (0, 3, 3, 10, 11, 11):  # a day that comes twice is corrected
        table = []
        for index in ("A", "B"):
            if index == "B" and k == 10:
                continue  # an index that a snapshot does not hold stays as it is
            members = {int(a): None if rng.random() < 0.2 else int(rng.integers(1, 3)) for a in range(6) if rng.random() < 0.6} or {9: 1}
            snaps[index, day(k)] = members
            table += [(index, day(k), a, w) for a, w in members.items()]
        snapshot = spark.createDataFrame(table * 2 + [(None, day(k), 1, 1), ("A", day(k), None, 1)], SNAPSHOT)
        changes = un.diff(stored, snapshot)
        stored = spark.createDataFrame(un.applied(stored, changes).collect(), VERSION)
        assert rows(stored) == plain_versions(snaps)
        assert un.diff(stored, snapshot).count() == 0  # a rerun changes nothing
    every = spark.createDataFrame([(i, d, a, w) for (i, d), m in snaps.items() for a, w in m.items()], SNAPSHOT)
    assert rows(un.versions(every)) == rows(stored)
    late = spark.createDataFrame([("A", day(2), 77, 1)], SNAPSHOT)
    assert un.diff(stored, late).count() == 0
    assert un.diff(stored, every.limit(0)).count() == 0


def test_the_kinds_of_change(spark):
    stored = spark.createDataFrame([("A", 1, 1, day(0), None), ("A", 2, 1, day(0), None), ("A", 3, 1, day(0), None), ("B", 5, 1, day(0), None), ("A", 5, 1, day(0), day(3))], VERSION)
    snapshot = spark.createDataFrame([("A", day(9), 1, 1), ("A", day(9), 2, 4), ("A", day(9), 4, 2), ("A", day(9), 5, 2)], SNAPSHOT)
    changes = un.diff(stored, snapshot)
    want = [("A", 2, "changed", 1, 4, day(9)), ("A", 3, "closed", 1, None, day(9)), ("A", 4, "opened", None, 2, day(9)), ("A", 5, "opened", None, 2, day(9))]
    assert rows(changes) == sorted(want, key=str)
    assert rows(un.newcomers(changes, stored)) == [(4, day(9))]  # 5 is held by B


def test_a_worklist_names_what_is_missing(spark):
    wanted = spark.createDataFrame([("x", day(k)) for k in range(3)] + [("y", day(0))], "source string, d date")
    x = spark.createDataFrame([(1, day(0)), (1, day(0)), (1, day(2)), (1, day(8)), (2, day(1)), (3, day(0)), (3, day(1)), (3, day(2))], "asset_id long, d date")
    y = spark.createDataFrame([(1, day(0))], "asset_id long, d date")
    new = spark.createDataFrame([(1,), (3,), (4,), (4,), (None,)], "asset_id long")
    got = rows(un.worklist(new, wanted, {"x": x, "y": y}))
    assert got == sorted([(1, "x", 3, 2, day(0), day(2)), (3, "y", 1, 0, None, None), (4, "x", 3, 0, None, None), (4, "y", 1, 0, None, None)], key=str)


def plain_compared(members, points):
    """(comparison, series, day): (value, drawdown) by walking the selected series' days."""
    out = {}
    for c in {m[0] for m in members}:
        chosen = next((m[1] for m in members if m[0] == c and m[2]), None)
        days = sorted(d for s, d in points if s == chosen)
        if not days:
            continue
        at = lambda s, d: points.get((s, max((e for t, e in points if t == s and e <= d), default=None)))
        mine = [m[1] for m in members if m[0] == c and at(m[1], days[-1]) is not None]
        base = next(d for d in days if all(at(s, d) is not None for s in mine))
        for s in mine:
            peak = None
            for d in days:
                if d >= base and at(s, base):
                    v = at(s, d) * at(chosen, base) / at(s, base)
                    peak = v if peak is None else max(peak, v)
                    out[c, s, d] = (v, v / peak - 1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_series_of_unlike_calendars_share_days_and_base(spark, seed):
    rng = np.random.default_rng(seed)
    points = {(s, day(int(k))): float(rng.integers(1, 50)) for s, lo, hi, n in (("r", 0, 40, 25), ("q", 5, 60, 12), ("i", -20, 30, 6), ("late", 70, 90, 4)) for k in rng.integers(lo, hi, n)}
    members = [(1, "r", True), (1, "q", False), (1, "i", False), (1, "late", False), (1, "none", False), (2, "q", True), (2, "r", None), (3, "none", True), (3, "r", False)]
    table = [(s, d, v, "x") for (s, d), v in points.items()] * 2 + [("r", None, 1.0, "x"), ("r", day(1), None, "x"), (None, day(1), 1.0, "x")]
    got = cmp.compared(spark.createDataFrame(members, "comparison_id long, series string, selected boolean"), spark.createDataFrame(table, "series string, d date, value double, selected string"))
    want = plain_compared(members, points)
    have = {(r.comparison_id, r.series, r.d): (r.value, r.drawdown) for r in got.collect()}
    assert have.keys() == want.keys() and 3 not in {k[0] for k in have}
    assert all(np.allclose(have[k], want[k]) for k in want)
    total = {(r.comparison_id, r.series): r for r in cmp.summary(got).collect()}
    for key, r in total.items():
        line = [want[k] for k in sorted(want) if k[:2] == key]
        assert r.days == len(line) and np.isclose(r.total_return, line[-1][0] / line[0][0] - 1) and np.isclose(r.max_drawdown, min(x[1] for x in line))


def test_empty_curves_and_a_base_of_zero(spark):
    members = spark.createDataFrame([(1, "r", True), (1, "z", False)], "comparison_id long, series string, selected boolean")
    curves = spark.createDataFrame([("r", day(0), 2.0), ("r", day(1), 3.0), ("z", day(0), 0.0), ("z", day(1), 5.0)], "series string, d date, value double")
    assert {r.series for r in cmp.compared(members, curves).collect()} == {"r"}
    assert cmp.compared(members, curves.limit(0)).count() == 0
    assert cmp.summary(cmp.compared(members.limit(0), curves)).count() == 0
