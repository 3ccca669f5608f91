"""Registered queries against their SQL on DuckDB. FULL_ORACLE=1 runs every key."""
import os

import pytest

from bourselake.plans import registry
from compare import check, connect
from conftest import SMALL

RUNS, SQL = registry.queries(), registry.oracle_sql()
SAMPLE = ("bars_normalize", "split_adjust", "history_upsert", "breadth_series", "features_panel", "indicator_snapshot",
          "absorption", "minervini_rs", "ewma_vol", "crossover", "pair_self_join", "flow_regime", "risk_metrics",
          "rolling_walk_forward", "perf_stats", "graph_bfs", "influence_edges", "signal_rank", "postmortem_cube",
          "news_items", "option_prices", "outliers", "concept_cluster", "draft_review", "breadth_health",
          "macro_regime", "stream_bars", "resume")
KEYS = sorted(SQL) if os.environ.get("FULL_ORACLE") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", KEYS)
def test_same_rows(spark, con, name):
    problem = check(spark, con, SMALL, name, RUNS[name], SQL[name])
    assert problem is None, problem


def test_every_key_is_registered_once():
    assert len(RUNS) > 230 and set(SQL) <= set(RUNS)


def test_entry_has_rows(spark):
    import __spark_entry__ as driver
    assert driver.entry(spark).count() > 0
