"""Every registered query runs, and equals its SQL twin where it has one."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, cell  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


# a cut through all topics; ALL_QUERIES=1 runs every one (as tools/check.py does at a larger scale)
CORE = """parse_series_name series_quality subject_coverage eligibility describe_percentiles duplicate_scan resample_linear sliding_windows
    window_features make_plan topk_depth train_test assert_no_leak group_kfold vote_series running_vote asof_call stable_since subject_scores
    athlete_summary confusion pull_rate pair_screen select_pairs bootstrap_ci paired_compare signed_rank_exact n_threshold equivalent_n
    fixed_effects_slopes variance_shares self_train standardize stream_windows stream_running_vote""".split()


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_QUERIES") else CORE)
def test_query(name, spark, sf, con):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(cell(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert got == want
