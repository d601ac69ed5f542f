"""Hand-computed cases of the operators."""

import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.parameters import Backtest, Screen, aligned_horizon
from panelforge.operators import backtest as bt
from panelforge.operators import crosssection as cs
from panelforge.operators import features as ft
from panelforge.operators import indicators as ind
from panelforge.operators import pointintime as pit
from panelforge.operators import scoring as sc
from panelforge.operators import signals as sig
from panelforge.operators import text as tx
from panelforge.plans import composites, services
from panelforge.plans.scores import prune_plan
from panelforge.sources import providers as pv
from panelforge.sources import sinks
from panelforge.streaming import alerts

DAY = date(2024, 1, 1)
BARS = "asset_id long, d date, c long, h long, l long, v long"


def path(spark, closes, asset=1, volumes=None):
    rows = [(asset, DAY + timedelta(i), c, c, c, (volumes or [1000] * len(closes))[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def names(df):
    return {r.signal_type for r in df.collect()}


def test_trade_decision(spark):
    x = spark.createDataFrame([(1, 90, 90, 90, 89, 89, 90.0, 90.0, 90.0, 0.7, "UP", 7)], "asset_id long, c long, high20 long, high60 long, low20 long, low60 long, upper double, lower double, average double, p double, label string, horizon int")
    plain = sc.decide(x).first()
    assert (plain.target, plain.stop) == (92.0, 89.0)
    held = sc.decide(x, least_gain=0.05, least_loss=0.03).first()
    assert (held.target, held.stop) == (94.5, 87.3)


@pytest.mark.parametrize(("values", "need", "keep"), [([6000, 2500, 1500] + [10] * 27, 2, 20), ([1] * 40, 32, 25)])
def test_importance_pruning(spark, values, need, keep):
    x = spark.createDataFrame([(1, f"f{i:02d}", v) for i, v in enumerate(values)], "model long, feature string, importance long")
    got = prune_plan(x).first()
    assert (got.need_80, got.keep) == (need, keep)


def test_macro_phases_and_intervals(spark):
    rows = [(DAY, 53, 1, 54, 2.0), (date(2024, 2, 1), 49, 1, 50, 3.0), (date(2024, 3, 1), 48, -1, 50, 2.0), (date(2024, 4, 1), 51, 3, 50, 2.0)]
    x = spark.createDataFrame(rows, "starts_at date, pmi int, slope int, non int, cpi double")
    x = x.select("starts_at", sc.phase(F.col("pmi"), F.col("slope"), F.col("non"), F.col("cpi")).alias("label"))
    got = pit.closed_intervals(x).orderBy("starts_at").collect()
    assert [r.label for r in got] == ["OVERHEAT", "STAGFLATION", "RECESSION", "RECOVERY"]
    assert [r.ends_at for r in got] == [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31), None]


def test_rs_score_ranks_and_flags(spark):
    frames = [path(spark, [1000 + 50 * i * k for k in range(21)], asset=i) for i in range(1, 6)]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    got = cs.rs_score(both).collect()
    assert len(got) == 5
    assert [r.asset_id for r in got if r.leads] == [5]


@pytest.mark.parametrize(
    ("closes", "signal"),
    [([1000] * 64 + [1500], "GOLDEN_CROSS"), ([1500] * 64 + [1000], "DEATH_CROSS"), ([10000, 10001] * 20, "BB_SQUEEZE"), ([1000] * 34 + [2000], "BB_BREAKOUT_UP"), ([1000] * 21 + [1100] * 5, "MOMENTUM_UP_5D"), ([1100] * 21 + [1000] * 5, "MOMENTUM_DOWN_5D")],
)
def test_signals(spark, closes, signal):
    assert signal in names(sig.fired(path(spark, closes)))


def test_volume_spike(spark):
    assert "VOLUME_SPIKE" in names(sig.fired(path(spark, [1000] * 25, volumes=[1000] * 24 + [3000])))


def test_flow_windows(spark):
    net, balance = [100, 50, 50, 0, 0, 60], [1000, 1100, 1080, 1200, 1190, 1300]
    rows = [(1, DAY + timedelta(i), n, 0, b) for i, (n, b) in enumerate(zip(net, balance, strict=True))]
    got = ind.flow_windows(spark.createDataFrame(rows, "asset_id long, d date, lg_buy long, lg_sell long, balance long")).orderBy("d").collect()
    assert [r.main_force_5d for r in got] == [100, 150, 200, 200, 200, 160]
    assert got[4].margin_change_5d is None and got[5].margin_change_5d == 300


def test_asof_takes_the_newest_known(spark):
    days = spark.createDataFrame([(1, date(2024, 4, 15)), (1, date(2024, 4, 30)), (1, date(2024, 5, 15)), (2, date(2024, 5, 1))], "asset_id long, d date")
    facts = spark.createDataFrame([(1, date(2023, 10, 30), 8), (1, date(2024, 3, 20), 10), (1, date(2024, 4, 30), 12)], "asset_id long, at date, roe long")
    got = pit.asof(days, facts, "asset_id", "d", "at", "roe").orderBy("asset_id", "d").collect()
    assert [r.roe for r in got] == [10, 12, 12, None]


def test_point_in_time_nav(spark):
    d0, d1 = DAY, DAY + timedelta(1)
    rows = [(1, d0, 10, 10, 10, 1), (2, d0, 20, 20, 20, 1), (1, d1, 12, 12, 12, 1), (2, d1, 18, 18, 18, 1)]
    members = spark.createDataFrame([("IDX1", d0, 1), ("IDX1", d0, 2), ("IDX2", d0, 1)], "index_code string, trade_date date, asset_id long")
    shares = spark.createDataFrame([(1, d0, 60), (2, d0, 40)], "asset_id long, available_date date, free_share long")
    got = cs.weighted_returns(spark.createDataFrame(rows, BARS), members, shares).collect()
    assert len(got) == 1 and got[0].n == 2 and got[0].overlap == 1
    assert got[0].ret_bp == pytest.approx(500.0)
    assert cs.nav(cs.weighted_returns(spark.createDataFrame(rows, BARS), members, shares)).first().nav == pytest.approx(105000.0)


def test_gap_of_one_day(spark):
    days = spark.createDataFrame([(DAY + timedelta(i),) for i in (1, 2, 3)], "d date")
    panel = spark.createDataFrame([(1, DAY + timedelta(1)), (1, DAY + timedelta(3))], "asset_id long, d date")
    got = pit.gaps(panel, days).collect()
    assert [(r.gap_start, r.gap_end, r.missing) for r in got] == [(date(2024, 1, 3), date(2024, 1, 3), 1)]


def test_membership_uses_whole_snapshots(spark):
    days = spark.createDataFrame([(DAY,), (DAY + timedelta(1),), (DAY + timedelta(2),)], "d date")
    members = spark.createDataFrame([("X", DAY, 1), ("X", DAY + timedelta(2), 2)], "index_code string, trade_date date, asset_id long")
    got = {(r.d, r.asset_id) for r in pit.members_on(days, members).collect()}
    assert got == {(DAY, 1), (DAY + timedelta(1), 1), (DAY + timedelta(2), 2)}


def test_heuristic_sums_to_one(spark):
    x = spark.createDataFrame([(0.05, 0.2, 0.9, 0.4, 7, "RECOVERY"), (0.0, 0.0, 0.5, 0.5, 3, ""), (-3.0, -1.0, 0.0, 1.0, 30, "RECESSION")], "mom5 double, sentiment double, rs double, bottom double, horizon int, macro_phase string")
    got = sc.heuristic(x).collect()
    assert all(abs(r.up + r.flat + r.down - 1) < 2e-4 for r in got)
    assert [r.label for r in got] == ["UP", "FLAT", "DOWN"]


def test_ladder(spark):
    got = spark.createDataFrame([(9.2,), (10.1,), (90.9,), (101.0,), (505.0,)], "p double").select(sc.ladder(F.col("p")).alias("x")).collect()
    assert [r.x for r in got] == [9.5, 11.0, 92.0, 105.0, 510.0]


def test_wilder_and_ema_by_hand(spark):
    closes = [100 + (i * 37) % 23 for i in range(40)]
    got = ind.ema_latest(path(spark, closes)).first()
    e = sum(closes[:5]) / 5
    for c in closes[5:]:
        e += (c - e) / 3
    assert got.ema_5 == pytest.approx(e, abs=1e-4)
    gains = [max(b - a, 0) for a, b in zip(closes, closes[1:], strict=False)]
    losses = [max(a - b, 0) for a, b in zip(closes, closes[1:], strict=False)]
    g, s = sum(gains[:14]) / 14, sum(losses[:14]) / 14
    for x, y in zip(gains[14:], losses[14:], strict=True):
        g, s = (g * 13 + x) / 14, (s * 13 + y) / 14
    assert ind.wilder_rsi_latest(path(spark, closes)).first().rsi == pytest.approx(100 * g / (g + s), abs=1e-4)


def test_adx_of_a_trend(spark):
    rows = [(1, DAY + timedelta(i), 100 + i, 101 + i, 99 + i, 1) for i in range(60)]
    got = ind.adx_latest(spark.createDataFrame(rows, BARS)).first()
    assert got.adx == pytest.approx(100.0) and got.minus_di == 0


CANDS = "run_id long, d date, asset_id long, rank long, exit_d date, target double, stop double"
RUNS = "run_id long, slots long, fraction double, stop_target boolean"


def test_backtest_closes_at_the_target(spark, tmp_path):
    days = [DAY + timedelta(i) for i in range(4)]
    prices = spark.createDataFrame([(7, d, c) for d, c in zip(days, [10.0, 11.0, 12.0, 13.0], strict=True)], "asset_id long, d date, c double")
    picks = spark.createDataFrame([(k, days[0], 7, 1, days[2], 11.0, 5.0) for k in (1, 2)] + [(3, days[0], 7, 1, days[1], 9.5, 10.5), (4, days[0], 7, 1, days[0], 1.0, 1.0)], CANDS)
    runs = spark.createDataFrame([(1, 1, 1.0, True), (2, 1, 1.0, False), (3, 1, 0.5, True), (4, 1, 1.0, True)], RUNS)
    states = bt.run(picks, prices, runs)
    got = {(r.run_id, r.d): r for r in bt.curve(states).collect()}
    assert [got[1, d].closed for d in days[:3]] == [0, 1, 0] and [got[2, d].closed for d in days[:3]] == [0, 0, 1]
    paid = 10 * 1.0005
    assert got[1, days[1]].equity == pytest.approx(100000 / 1.001 / paid * 11 * 0.9995 * 0.999, rel=1e-12)
    assert got[2, days[1]].equity == pytest.approx(100000 / 1.001 / paid * 11, rel=1e-12)
    sold = {r.run_id: r.reason for r in bt.trades(states).collect() if r.side == "SELL"}
    assert sold == {1: "TARGET_PRICE", 2: "SCHEDULED", 3: "TARGET_PRICE"}  # a candidate that exits on its day is never bought
    assert not [r for r in got if r[0] == 4]


def by_hand(days, prices, picks, slots, fraction):
    """The run loop as a plain loop."""
    cash, held, out = 100000.0, [], []
    for d in days:
        kept, closed, wins = [], 0, 0
        for x in held:
            c = prices.get((x["asset"], d))
            if c is None or not (c <= x["stop"] or c >= x["target"] or d >= x["exit"]):
                kept.append(x)
                continue
            got = x["qty"] * c * 0.9995 * 0.999
            cash, closed, wins = cash + got, closed + 1, wins + (got > x["cost"])
        held = kept
        chosen = picks.get(d, [])[: max(0, slots - len(held))]
        if chosen and cash >= 0.01:
            part = min(cash, 100000 * fraction) / len(chosen) / 1.001
            for asset, exit_d, target, stop in chosen:
                if (c := prices.get((asset, d))) is not None:
                    cash -= part * 1.001
                    held.append({"asset": asset, "qty": part / (c * 1.0005), "cost": part * 1.001, "buy": c * 1.0005, "exit": exit_d, "target": target, "stop": stop})
        out.append((d, cash + sum(x["qty"] * prices.get((x["asset"], d), x["buy"]) for x in held), cash, len(held), closed, wins))
    return out


def test_a_stopped_backtest_goes_on_where_it_ended(spark, tmp_path):
    rng = np.random.default_rng(2)
    days = [DAY + timedelta(i) for i in range(30)]
    prices = {(a, d): float(np.round(20 + 3 * rng.normal(), 2)) for a in range(6) for d in days if rng.random() < 0.85}
    picks = {d: [(int(a), days[min(29, i + int(rng.integers(1, 6)))], 23.0, 17.0) for a in rng.permutation(6)[:3]] for i, d in enumerate(days[:-1])}
    bars = spark.createDataFrame([(a, d, c) for (a, d), c in prices.items()], "asset_id long, d date, c double")
    rows = [(run, d, a, k, e, t, s) for run in (1, 2) for d, some in picks.items() for k, (a, e, t, s) in enumerate(some)]
    cands, runs = spark.createDataFrame(rows, CANDS), spark.createDataFrame([(1, 4, 1.0, True), (2, 2, 0.3, True)], RUNS)
    whole = sorted(map(tuple, bt.curve(bt.run(cands, bars, runs)).collect()))
    for run, slots, fraction in ((1, 4, 1.0), (2, 2, 0.3)):
        want = by_hand(days, prices, picks, slots, fraction)
        got = [r[1:] for r in whole if r[0] == run]
        assert [g[0] for g in got] == [w[0] for w in want] and [g[3:] for g in got] == [w[3:] for w in want]
        assert np.allclose([g[1:3] for g in got], [w[1:3] for w in want], rtol=1e-12, atol=1e-6)
    folder = f"file://{tmp_path}/run"
    for stop in (1, 2, 1, None):
        states = bt.run(cands, bars, runs, chunk=7, folder=folder, most_chunks=stop)
    assert sorted(map(tuple, bt.curve(states).collect())) == whole


def test_metrics_and_rebase(spark):
    rows = [(1, DAY + timedelta(i), e, e, 0, 0, 0) for i, e in enumerate([100000.0, 110000.0, 99000.0])]
    got = bt.metrics(spark.createDataFrame(rows, bt.EVENTS)).first()
    assert got.total_return == pytest.approx(-0.01) and got.max_drawdown == pytest.approx(0.1)
    series = spark.createDataFrame([("nav", DAY, 100000.0), ("nav", DAY + timedelta(1), 102000.0)], "series string, d date, nav double")
    assert [r.value for r in bt.rebased(series, "nav", 200000.0).orderBy("d").collect()] == [200000.0, 204000.0]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, sinks.upserted(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.inserted(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, sinks.first_of([old, new], "k").collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_text(spark):
    docs = spark.createDataFrame([(1, "Buy, upgrade: sell! chipco"), (2, None)], "article_id long, text string")
    got = {r.article_id: r for r in tx.sentiment(docs).collect()}
    assert got[1].sentiment == 1.0 and got[1].label == "POSITIVE" and got[2].sentiment == 0.0
    aliases = spark.createDataFrame([("chipco", 9)], "alias string, asset_id long")
    assert [(r.article_id, r.asset_id) for r in tx.link(docs, aliases).collect()] == [(1, 9)]


def test_aliases_are_linked_anywhere_in_the_text(spark):
    texts = {1: "Bought SH600000 and\nKweichow  Mou\ttai.", 2: "今天贵州茅 台上涨", 3: "no 16000005 here", 4: None, 5: "xchipcox", 6: "a b c d e f g h i j"}
    docs = spark.createDataFrame(list(texts.items()), "article_id long, text string")
    names = [("600000", 1), ("Kweichow Moutai", 2), ("moutai", 2), ("贵州茅台", 3), ("Chipco", 4), (" ", 5)] + [(c, 10 + k) for k, c in enumerate("jihgfedcba")]
    aliases = spark.createDataFrame(names, "alias string, asset_id long")
    got = {}
    for r in tx.link_anywhere(docs, aliases).where("length(alias) > 1").orderBy("article_id", "rank").collect():
        got.setdefault(r.article_id, []).append((r.asset_id, r.alias))
    assert got == {1: [(2, "Kweichow Moutai"), (1, "600000")], 2: [(3, "贵州茅台")], 5: [(4, "Chipco")]}
    assert [r.asset_id for r in tx.link_anywhere(docs, aliases).where("article_id = 6").orderBy("rank").collect()] == list(range(10, 18))


def test_aliases_in_several_parts_link_the_same(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abC1 ")) for _ in range(n))
    texts = [(i, word(60)) for i in range(40)] + [(0, "second row of an article a1b")]
    names = [(k, word(int(rng.integers(1, 5)))) for k in range(60)]
    docs, aliases = spark.createDataFrame(texts, "article_id long, text string"), spark.createDataFrame(names, "asset_id long, alias string")
    best = {}
    for i, text in texts:
        low = "".join(text.lower().split())
        for asset, alias in names:
            piece = alias if alias.isdigit() else "".join(alias.lower().split())
            if piece and (re.search(rf"(?<![0-9]){alias}(?![0-9])", text) if alias.isdigit() else piece in low):
                best[i, asset] = max(best.get((i, asset), (0, "")), (len(piece), alias))
    want = {}
    for (i, asset), (n, alias) in best.items():
        want.setdefault(i, []).append((-n, asset, alias))
    want = sorted((i, asset, alias, k + 1) for i, hits in want.items() for k, (_, asset, alias) in enumerate(sorted(hits)[:8]))
    for most in (1, 10**6):
        assert sorted(map(tuple, tx.link_anywhere(docs, aliases, most_bytes=600 if most == 1 else most).collect())) == want


def test_aliases_of_a_company(spark):
    rows = [(1, "比亚迪股份有限公司", "002594", "002594.SZ"), (2, "贵州茅台", "600519", "600519.SH"), (3, "A集团", "3", None), (4, None, " 4 ", "4.X"), (5, "中国科技集团", "5", "5.Y")]
    got = {}
    for r in tx.aliases_of(spark.createDataFrame(rows, "asset_id long, name string, symbol string, code string")).collect():
        got.setdefault(r.asset_id, set()).add(r.alias)
    assert got == {1: {"比亚迪股份有限公司", "比亚迪", "002594", "002594.sz"}, 2: {"贵州茅台", "茅台", "600519", "600519.sh"}, 3: {"A集团", "3"}, 4: {"4", "4.x"}, 5: {"中国科技集团", "中国", "5", "5.y"}}


def test_alert_cooldown(spark):
    ts = [pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h) for h in (0, 1, 6, 7, 13)]
    events = spark.createDataFrame(pd.DataFrame({"event_type": "a", "event_id": range(5), "ts": ts, "value": 99.0}), "event_type string, event_id long, ts timestamp_ntz, value double")
    assert sorted(r.event_id for r in alerts.fired(events, 95.0).collect()) == [0, 2, 4]


@pytest.mark.parametrize("parts", [0, 3])
def test_alert_stream_reads_files_and_folders(spark, tmp_path, parts):
    rows = [(i, "ab"[i % 2], DAY + timedelta(hours=i), 96.0 if i % 3 else 90.0) for i in range(60)]
    events = pd.DataFrame(rows, columns=["event_id", "event_type", "ts", "value"])
    events["ts"] = pd.to_datetime(events["ts"]) + pd.to_timedelta(events["event_id"], unit="h")
    table = tmp_path / "events.parquet"
    if parts:
        table.mkdir()
        for k in range(parts):
            events[k::parts].to_parquet(table / f"part-{k}.parquet", coerce_timestamps="us")
    else:
        events.to_parquet(table, coerce_timestamps="us")
    d = f"file://{tmp_path}"
    got = composites.alert_stream(spark, d).select("event_type", "event_id").collect()
    want = alerts.fired(spark.read.parquet(f"{d}/events.parquet"), 95.0).select("event_type", "event_id").collect()
    assert len(got) > 4 and sorted(got) == sorted(want)


def test_parameters_are_clamped_and_checked():
    assert Screen.of({"limit": "0", "high": "x", "ratio": "99", "suggested": "No"}) == Screen(1, 70.0, 30.0, 20, "", False)
    assert aligned_horizon("up_prob_30d", 3) == 30 and aligned_horizon("up_prob_9d", 3) == 3 and aligned_horizon("bottom", 7) == 7
    good = Backtest(DAY, DAY + timedelta(9), metric="up_prob_3d")
    assert not good.checked() and good.aligned().horizon == 3
    assert len(Backtest(DAY, DAY, 0, 0, 2.0, 5, top=0).checked()) == 6


def test_providers(spark):
    raw = {"a": spark.createDataFrame([("20240101", "1"), ("none", "2")], "day string, x string"), "b": spark.createDataFrame([(DAY, None)], "day date, y long")}
    maps = {"a": pv.Mapping({"d": "try_to_date(day, 'yyyyMMdd')", "v": "cast(x as bigint)"}, ("d",)), "b": pv.Mapping({"d": "day", "v": "y"})}
    assert sorted((r.provider, str(r.d), r.v) for r in pv.dispatch(raw, maps).collect()) == [("a", "2024-01-01", 1), ("b", "2024-01-01", None)]
    with pytest.raises(ValueError):
        pv.dispatch(raw, {"a": maps["a"]})
    got = pv.filled(spark.createDataFrame([(1, None, 5), (2, 3, None)], "k long, x long, y long"), spark.createDataFrame([(1, 7, 8), (3, 9, None)], "k long, x long, y long"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, 7, 5), (2, 3, None), (3, 9, None)]
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "k long, seq long, v long")
    assert sorted((r.k, r.v) for r in pv.last_wins(rows, ["k"], "seq").collect()) == [(1, 6), (2, 7)]
    windows = pv.backward_windows(spark.createDataFrame([(DAY,)], "d date"), "2030-01-01", "2023-12-01", 20)
    assert [(str(r.start_d), str(r.end_d)) for r in windows.orderBy("step").collect()] == [("2023-12-12", "2023-12-31"), ("2023-12-01", "2023-12-11")]


def test_alerts_follow_the_fold(spark):
    """Dense, sparse and tied events, several types: the same as one fold in order."""
    import random

    rng = random.Random(4)
    rows = [(k, f"t{k % 3}", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=rng.randrange(60 * 24 * (3 if k % 3 else 40))), 99.0) for k in range(400)]
    events = spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "event_type", "ts", "value"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want, last = set(), {}
    for t, i, kind in sorted((r[2], r[0], r[1]) for r in rows):
        if kind not in last or (t - last[kind]).total_seconds() >= alerts.COOLDOWN_S:
            want.add(i)
            last[kind] = t
    assert {r.event_id for r in alerts.fired(events, 95.0).collect()} == want
    assert alerts.fired(events.limit(0), 95.0).count() == 0


def test_alert_seconds_and_repeated_ids(spark):
    """Whole seconds are rounded, halves to even, as in SQL; events of one id at several times are several, and equal ones are one."""
    ms = (400, 21_600_000 - 600, 21_600_000 - 400, 43_200_000 - 600, 43_200_000 - 500)
    frame = pd.DataFrame([("a", 7, pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=t), 99.0) for t in (*ms, ms[0])], columns=["event_type", "event_id", "ts", "value"])
    events = spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = [frame["ts"][k] for k in (0, 2, 4)]
    assert [r[2] for r in alerts._fold(frame, None)[0]] == want
    assert sorted(r.ts for r in alerts.fired(events, 95.0).collect()) == want


def test_feature_scaler_beyond_long(spark, tmp_path):
    """Rows times the sum of squares exceeds a long: the sums are decimals."""
    n = 200_000
    spark.range(n).selectExpr("id as l_suppkey", "timestamp_ntz '1998-01-01' as l_shipdate", "4.01D + id % 7 as l_extendedprice", "cast(id % 50 + 1 as double) as l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    c = np.array([max(20000 + (401 + 100 * (i % 7)) % 801 - 400, 100) for i in range(n)], dtype=float)
    v = np.arange(n) % 50 + 1.0
    got = services.QUERIES["m31_feature_scaler"][0](spark, f"file://{tmp_path}").first()
    assert np.allclose([got.c_mean, got.c_dev, got.v_mean, got.v_dev], [x * 10000 for x in (c.mean(), c.std(), v.mean(), v.std())], atol=1)


def test_feature_matrix_by_hand(spark):
    """Twelve days: changes over rows, neutral values before scores are known, phases as numbers, members only."""
    days = [DAY + timedelta(i) for i in range(12)]
    bars = path(spark, [1000 + 100 * i for i in range(12)])
    rs = spark.createDataFrame([(1, days[10], 0.9)], "asset_id long, d date, rs_score double")
    factors = spark.createDataFrame([(1, days[11], *[0.25] * len(ft.FACTORS))], "asset_id long, d date, " + ", ".join(f"{n} double" for n in ft.FACTORS))
    macro = spark.createDataFrame([(DAY, None, 51, 300, 250, "STAGFLATION")], "date date, pmi long, non_pmi long, y10 long, y2 long, phase string")
    sentiment = spark.createDataFrame([(days[0], 0.4), (days[1], -0.2)], "published date, sentiment double")
    x = ft.matrix(bars, rs, factors, macro, sentiment)
    got = {r.d: r for r in x.collect()}
    assert len(got) == 12
    first, last = got[days[0]], got[days[11]]
    assert (first.ret_5, first.rsi_delta_3, first.ret_5_delta_10, first.rs_score, first.pe_percentile, first.sentiment_20) == (0, 0, 0, 0.5, 0.5, 0.4)
    assert got[days[1]].sentiment_20 == 0.1
    assert got[days[10]].rs_delta_3 == 0.4 and last.rs_delta_3 == 0
    assert last.ret_5 == round(500 / 1600, 4) and last.ret_5_delta_3 == round(last.ret_5 - round(500 / 1300, 4), 4)
    assert (last.pmi, last.non_pmi, last.curve, last.phase_code, last.northbound) == (50, 51, 0.5, 3, 0.5)
    assert (last.pe_percentile, last.pe_x_phase, last.rsi_x_phase) == (0.25, 0.75, 150)
    members = spark.createDataFrame([(days[3], 1), (days[5], 1), (days[8], 2)], "d date, asset_id long")
    assert [r.d for r in ft.point_in_time(x, members, str(days[4]), str(days[11])).collect()] == [days[5]]
