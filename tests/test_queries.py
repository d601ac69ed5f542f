"""The driver's contract, and a sample of queries against their SQL."""

import os
import shutil
import subprocess
import sys
from numbers import Real

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["s0_bars", "w2_rsi_rolling", "w19_rs_score", "g11_all_signals", "j3_asof_fundamentals", "j4_index_membership", "m18_trade_decisions", "m20_lexicon_sentiment", "w23_gaps", "r2_alerts_batch"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if pd.isna(v) else (round(float(v), 6) if isinstance(v, Real) and not isinstance(v, bool) else str(v).replace(" 00:00:00", ""))
    return sorted(map(str, (tuple(clean(v) for v in r) for r in frame.itertuples(index=False))))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_subpackage(tmp_path):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(here, "panelforge"), tmp_path / "panelforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 's0_bars' in q and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True)
