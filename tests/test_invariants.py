"""No look-ahead, and results that depend on neither row order nor partition count."""
import pytest
from pyspark.sql import functions as F

from bourselake.operators import backtest as bt, indicators as ind
from bourselake.operators.breadth import breadth_series


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.fillna(-9e9).collect())


@pytest.fixture(scope="module")
def bars(market):
    return market.bars.persist()


@pytest.mark.parametrize("operator", [ind.feature_panel, ind.with_adx, ind.with_absorption, ind.deviation_z(), bt.signal_patterns])
def test_no_look_ahead(bars, operator):
    cut = "1998-06-30"
    early = operator(bars.filter(F.col("date") <= cut))
    assert rows(early) == rows(operator(bars).filter(F.col("date") <= cut))


def test_order_and_partitions_do_not_matter(bars):
    base = rows(breadth_series(bars))
    assert base == rows(breadth_series(bars.orderBy(F.rand(7)).repartition(3)))
    assert base == rows(breadth_series(bars.repartition(17, "date")))


def test_scores_stay_in_range(bars):
    low, high = ind.with_absorption(bars).agg(F.min("absorption"), F.max("absorption")).first()
    assert 0 <= low <= high <= 1
