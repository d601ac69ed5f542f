"""What scores share is worked out once, in few shuffles, whose partitions follow the size of the panel."""

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge.functions.columns import mean, run_mean, run_spread, running, spread
from panelforge.operators import crosssection as cs
from panelforge.operators import picks as pk
from panelforge.operators import scoring as sc
from panelforge.plans import comparisons, composites
from panelforge.plans import scores as plans
from panelforge.sources import panel
from tests.test_shuffles import exchanges

DAY = date(2024, 1, 1)
DATA = "/root/testdata/sf0.001"


def _bars(spark, n=130):
    rng = np.random.default_rng(11)
    rows = [(a, DAY + timedelta(k), int(c), int(c + rng.integers(9)), int(c - rng.integers(9)), int(rng.integers(1, 50))) for a, m in ((1, n), (2, 58), (3, 4)) for k, c in enumerate(rng.integers(100, 400, m))]
    return spark.createDataFrame(rows, "asset_id long, d date, c long, h long, l long, v long"), rows


def test_running_sums_are_the_sums_of_frames(spark):
    bars, _ = _bars(spark)
    x = running(bars.withColumn("c", F.when(F.col("c") % 7 != 0, F.col("c"))), "c", squares=("c",))
    x = x.select(run_mean("c", 5).alias("a"), mean("c", 5).alias("b"), run_mean("c", 6, end=1).alias("e"), mean("c", 6, end=1).alias("f"), run_spread("c", 5).alias("g"), spread("c", 5).alias("h")).collect()
    assert any(r.a is not None for r in x) and all((r.a, r.e, r.g) == (r.b, r.f, r.h) for r in x)


def test_highs_of_sixty_rows_are_those_of_short_windows(spark):
    bars, rows = _bars(spark)
    got = {(r.asset_id, r.d): r for r in sc.decision_inputs(bars).collect()}
    for a in (1, 2, 3):
        own = [r for r in rows if r[0] == a]
        for k, r in enumerate(own):
            x = got[a, r[1]]
            for n in (20, 60):
                part = own[max(0, k - n + 1) : k + 1]
                assert x[f"high{n}"] == max(p[3] for p in part) and x[f"low{n}"] == min(p[4] for p in part)


def test_percentiles_together_are_those_one_by_one(spark):
    rows = [(k % 3, k, None if k % 5 == 0 else k * 7 % 11, k % 4) for k in range(60)]
    x = spark.createDataFrame(rows, "d long, k long, a long, b long")
    one = {r.k: (r.p, r.q) for r in x.select("k", cs.percentile("a", "d").alias("p"), cs.percentile("b", "d").alias("q")).collect()}
    assert {r.k: (r.a_rank, r.b_rank) for r in cs.percentiles(x, "d", "a", "b").collect()} == one


def test_the_mean_of_sources_in_a_row_is_that_of_their_rows(spark):
    rows = [(1, 0.12345, 0.5), (2, None, 0.33333), (3, 0.7, None), (4, None, None)]
    x = spark.createDataFrame(rows, "asset_id long, a double, b double")
    wide = {r.asset_id: r.m for r in x.select("asset_id", pk.combined_value(F.col("a"), F.col("b")).alias("m")).collect()}
    each = x.select("asset_id", F.explode(F.array("a", "b")).alias("up")).select(F.lit("s").alias("source"), F.lit(7).alias("horizon"), "asset_id", F.lit(DAY).alias("d"), "up", F.col("up").alias("trade_score"))
    assert wide == {r.asset_id: r.up for r in pk.combined(each).collect()}


def test_partitions_follow_the_panel(spark, monkeypatch):
    panel.release()
    assert panel.parts(spark, DATA) is None
    monkeypatch.setattr(panel, "ROWS_EACH", 500)
    n = panel.parts(spark, DATA)
    assert n == -(-panel.table(spark, DATA, "lineitem").count() // 500) > 3
    plan = plans.factors(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"], {n}") >= 2  # by asset and by day; before, both had the session's three
    panel.release()


def test_a_panel_beyond_a_partition_a_core_is_not_merged_to_fewer(spark, monkeypatch):
    panel.release()
    need = -(-panel.table(spark, DATA, "lineitem").count() // 500)
    monkeypatch.setattr(panel, "ROWS_EACH", 500)
    session = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(need + 9))
        assert panel.parts(spark, DATA) == need + 9  # none before: partitions of a day's rows were merged by their compressed bytes
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", session)


def test_a_kept_panel_with_partitions_of_its_own_meets_fundamentals_where_it_lies(spark, monkeypatch):
    panel.release()
    want = {tuple(r) for r in plans.factors(spark, DATA).collect()}
    plan = lambda: plans.factors(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    few = plan().count("Exchange hashpartitioning")
    panel.release()
    monkeypatch.setattr(panel, "ROWS_EACH", 500)
    assert {tuple(r) for r in plans.factors(spark, DATA).collect()} == want
    assert plan().count("Exchange hashpartitioning") == few  # one more before: all rows of the panel by asset again
    panel.release()


def test_indices_of_a_comparison_are_read_from_the_kept_panel(spark, monkeypatch):
    panel.release()
    read = []
    daily = panel.daily
    monkeypatch.setattr(panel, "daily", lambda s, d: read.append(d) or daily(s, d))
    comparisons.run_comparison(spark, DATA)
    assert read == [DATA]  # twice before, and shuffled for each index
    panel.release()


def test_scores_and_ranks_share_their_shuffles(spark):
    queries = entry.queries()
    for name, most in (("m3_factor_scores", 5), ("m7_heuristic_predictions", 10), ("b3_combined_candidates", 10), ("qa_stock_board", 23)):  # 8, 18, 29 and 59 before
        assert exchanges(queries[name](spark, DATA)) <= most, name


def test_candidates_look_at_the_bars_of_picked_assets_only(spark):
    x, _, _ = composites.candidates(spark, DATA)
    assert "Window" not in x._jdf.queryExecution().optimizedPlan().toString()  # written, not worked out again for prices, picks and spans
