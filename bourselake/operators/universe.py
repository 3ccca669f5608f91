"""As-of cuts, latest bars and composable universe filters."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.functions import avg_full, bands, yes
from bourselake.operators.indicators import sma, with_rsi

CRORE = 1e7


def resolved_date(df: DataFrame, as_of: str) -> Column:
    """Latest available date at or before `as_of`, as a scalar subquery."""
    return df.filter(F.col("date") <= F.lit(as_of).cast("date")).agg(F.max("date")).scalar()


def asof_cut(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(F.col("date") <= F.lit(as_of).cast("date")).withColumn(
        "target_date", resolved_date(df, as_of))


def at_target(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(F.col("date") == resolved_date(df, as_of))


def latest_bar(df: DataFrame, columns: list[str]) -> DataFrame:
    """Last row per symbol with a valid close."""
    return (df.filter("close IS NOT NULL").groupBy("symbol")
            .agg(F.max("date").alias("date"), F.max_by(F.struct(*columns), "date").alias("r"))
            .select("symbol", "date", "r.*"))


def tradable(panel: DataFrame, min_price: float, min_avg_volume: float) -> DataFrame:
    return panel.filter((F.col("close") >= min_price) & (F.col("vol_avg20") >= min_avg_volume)
                        & F.col("ma50").isNotNull() & F.col("ma200").isNotNull())


def with_turnover(df: DataFrame, n: int = 20, least: int = 1) -> DataFrame:
    return df.withColumn("turnover_cr", avg_full(F.col("close") * F.col("volume"), n, least)
                         / F.lit(CRORE))


def universe_metrics(bars: DataFrame) -> DataFrame:
    """Latest close, flags against two means, strength, window return, turnover, delivery."""
    df = with_turnover(with_rsi(bars, out="rsi_14"))
    df = df.withColumn("_50", sma("close", 50)).withColumn("_200", sma("close", 200))
    latest = F.max_by(F.struct("close", "_50", "_200", "rsi_14", "turnover_cr"), "date")
    stats = df.groupBy("symbol").agg(latest.alias("r"), F.min_by("close", "date").alias("_a"),
                                     F.avg("delivery_pct").alias("avg_delivery_pct"))
    close = F.col("r.close")
    return stats.select(
        "symbol", close.alias("close"), yes(close > F.col("r._50")).alias("above_50"),
        yes(close > F.col("r._200")).alias("above_200"), F.col("r.rsi_14").alias("rsi_14"),
        (close / F.col("_a") - 1).alias("ret_window"), F.col("r.turnover_cr").alias("turnover_cr"),
        "avg_delivery_pct")


def build_universe(metrics: DataFrame, fundamentals: DataFrame | None = None, *,
                   liquidity_min_cr: float | None = None, above_ma: int | None = None,
                   momentum_min: float | None = None, delivery_min: float | None = None,
                   roce_min: float | None = None, debt_max: float | None = None,
                   sales_growth_min: float | None = None) -> DataFrame:
    """One pass flag per requested filter and the overall verdict; nulls fail a filter.

    Fundamentals are joined to price survivors only, so the costly side is read for few keys.
    """
    flags: dict[str, Column] = {}
    if liquidity_min_cr is not None:
        flags["pass_liquidity"] = yes(F.col("turnover_cr") >= liquidity_min_cr)
    if above_ma is not None:
        flags["pass_ma"] = F.coalesce(F.col({50: "above_50", 200: "above_200"}[above_ma]),
                                      F.lit(False))
    if momentum_min is not None:
        flags["pass_momentum"] = yes(F.col("ret_window") >= momentum_min)
    if delivery_min is not None:
        flags["pass_delivery"] = yes(F.col("avg_delivery_pct") >= delivery_min)
    df = metrics.withColumns(flags) if flags else metrics
    price_ok = reduce(lambda a, b: a & b, [F.col(n) for n in flags], F.lit(True))
    if fundamentals is None:
        return df.withColumn("passes", price_ok)
    survivors = df.filter(price_ok).select("symbol")
    looked_up = fundamentals.join(survivors, "symbol", "left_semi")
    df = df.join(looked_up, "symbol", "left")
    extra: dict[str, Column] = {}
    if roce_min is not None:
        extra["pass_roce"] = yes(F.col("roce_pct") >= roce_min)
    if debt_max is not None:
        extra["pass_debt"] = yes(F.col("debt_to_equity") <= debt_max)
    if sales_growth_min is not None:
        extra["pass_growth"] = yes(F.col("sales_growth_5y") >= sales_growth_min)
    df = df.withColumns(extra) if extra else df
    verdict = reduce(lambda a, b: a & b, [F.col(n) for n in extra], price_ok)
    return df.withColumn("passes", verdict)


def overbought_label(ratio, high: float, low: float) -> Column:
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.when(ratio > high, "overbought").when(ratio < low, "oversold").otherwise("neutral")


# Descending class thresholds in percent.
BREADTH_200_CLASSES = ((60.0, "healthy"), (50.0, "narrow_rally"), (40.0, "caution"),
                       (0.0, "fragile"))
BREADTH_8_CLASSES = ((73.0, "overbought"), (60.0, "healthy_bullish"), (40.0, "neutral"),
                     (23.0, "bearish"), (0.0, "oversold"))
UPTREND_CLASSES = ((37.0, "overbought"), (30.0, "neutral_bullish"), (20.0, "neutral"),
                   (15.0, "neutral_bearish"), (0.0, "bearish"))


def classify(value, steps) -> Column:
    """Label of the first threshold reached; anything below the last one takes the last label."""
    return bands(value, steps, steps[-1][1])


def rescale_percent(c) -> Column:
    """Shares up to one become percent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) <= 1, c * 100).otherwise(c)


# Letter grades.
GRADES = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4, "F": 0.2}


def unit_score(c) -> Column:
    """Score text (0-1, 0-100 or a letter grade) to 0..1; anything else is 0."""
    c = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    number = c.try_cast("double")
    scaled = F.when(number > 1, number / 100).otherwise(number)
    grade = F.lit(0.0)
    for letter, value in GRADES.items():
        grade = F.when(c == letter, F.lit(value)).otherwise(grade)
    return F.when(number.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
                  ).otherwise(grade)


def cell_number(c) -> Column:
    """First number in a display cell such as a grouped amount or a percentage."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
