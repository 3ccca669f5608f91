"""Co-movement of series: lead-lag, rolling correlation, crossovers, spreads."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import lagged, safe_div, stddev_full, avg_full, trailing


def lead_lag(edges: DataFrame, series: DataFrame, max_lag: int = 5, least: int = 30) -> DataFrame:
    """corr(x_t, y_{t+L}) for L = 0..max_lag per edge (src, dst); strongest lead, ties to small L.

    `series(node, date, r)`. An edge expands to its shared dates only: edges x dates rows.
    """
    x = series.select(F.col("node").alias("src"), "date", F.col("r").alias("x"))
    y = series.select(F.col("node").alias("dst"), "date", F.col("r").alias("y"))
    both = edges.select("src", "dst").join(x, "src").join(y, ["dst", "date"])
    w = Window.partitionBy("src", "dst").orderBy("date")
    for lag in range(max_lag + 1):
        both = both.withColumn(f"y{lag}", F.lead("y", lag).over(w) if lag else F.col("y"))
    corrs = [_corr("x", f"y{lag}").alias(f"c{lag}") for lag in range(max_lag + 1)]
    agg = both.groupBy("src", "dst").agg(F.count("*").alias("n"), *corrs)
    best_lag, best = F.lit(0), F.col("c0")
    for lag in range(1, max_lag + 1):
        better = F.coalesce(F.abs(F.col(f"c{lag}")) > F.abs(best), F.lit(False))
        best_lag = F.when(better, F.lit(lag)).otherwise(best_lag)
        best = F.when(better, F.col(f"c{lag}")).otherwise(best)
    enough = F.col("n") >= least
    out = edges.join(agg, ["src", "dst"], "left")
    return (out.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
            .withColumn("corr0", F.when(enough, F.col("c0")))
            .withColumn("lead_lag", F.when(enough & F.col("c0").isNotNull(), best_lag).cast("double"))
            .withColumn("lead_corr", F.when(enough, best))
            .drop(*[f"c{lag}" for lag in range(max_lag + 1)]))


def _corr(a: str, b: str) -> Column:
    value = F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    return F.when(F.isnan(value), None).otherwise(value)


def rolling_corr(a: str, b: str, n: int, part: str = "symbol", order: str = "month") -> Column:
    """Correlation over the last n rows, 0 when one side does not vary, null until full."""
    w = trailing(n, part, order)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    ready = F.count(F.when(both, F.lit(1))).over(w) == n
    flat = (F.stddev_pop(a).over(w) == 0) | (F.stddev_pop(b).over(w) == 0)
    return F.when(ready, F.when(flat, F.lit(0.0)).otherwise(F.corr(a, b).over(w)))


def crossover(monthly: DataFrame, value: str = "close", short: int = 6, long: int = 12,
              look_back: int = 12) -> DataFrame:
    """Latest golden or death cross of two means, its age in months and the present gap.

    Series shorter than long + 3 report none.
    """
    w = Window.partitionBy("symbol").orderBy("month")
    df = monthly.withColumn("s", avg_full(value, short, order="month")).withColumn(
        "l", avg_full(value, long, order="month"))
    df = df.withColumn("ps", F.lag("s").over(w)).withColumn("pl", F.lag("l").over(w))
    df = df.withColumn("ago", F.row_number().over(
        Window.partitionBy("symbol").orderBy(F.desc("month"))) - 1)
    kind = (F.when((F.col("ps") <= F.col("pl")) & (F.col("s") > F.col("l")), "golden_cross")
            .when((F.col("ps") >= F.col("pl")) & (F.col("s") < F.col("l")), "death_cross"))
    hit = F.when(kind.isNotNull() & (F.col("ago") < look_back), F.col("ago"))
    agg = df.groupBy("symbol").agg(
        F.count("*").alias("n"), F.min_by(F.struct("s", "l"), "ago").alias("now"),
        F.min_by(kind, hit).alias("kind"), F.min(hit).alias("bars_ago"))
    ready = F.col("n") >= long + 3
    gap = safe_div(F.col("now.s") - F.col("now.l"), F.col("now.l")) * 100
    agg = agg.withColumn("gap_pct", F.when(ready, gap))
    label = (F.when(~ready, "none").when(F.col("kind").isNotNull(), F.col("kind"))
             .when(F.abs("gap_pct") < 1.0, "converging").otherwise("none"))
    return agg.select("symbol", label.alias("type"),
                      F.when(ready, F.col("bars_ago")).cast("double").alias("bars_ago"), "gap_pct")


def percentile_of_latest(df: DataFrame, value: str, key: str = "symbol", order: str = "date"
                         ) -> DataFrame:
    """Share of the history strictly below the latest value, and the mid-rank variant."""
    latest = df.groupBy(key).agg(F.max_by(value, order).alias("current"))
    both = df.join(latest, key)
    n = F.count(value)
    below, same = F.count_if(F.col(value) < F.col("current")), F.count_if(F.col(value) == F.col("current"))
    return both.groupBy(key).agg(F.max("current").alias("current"),
                                 (below / n * 100).alias("percentile"),
                                 ((below + same / 2) / n * 100).alias("mid_percentile"))


def hedge_spread(pairs: DataFrame, series: DataFrame, value: str = "close", look_back: int = 20
                 ) -> DataFrame:
    """Spread y - beta*x - alpha per pair (y, x) on shared dates, its rolling z and extreme flag."""
    y = series.select(F.col("symbol").alias("y"), "date", F.col(value).alias("vy"))
    x = series.select(F.col("symbol").alias("x"), "date", F.col(value).alias("vx"))
    both = pairs.select("y", "x").join(y, "y").join(x, ["x", "date"])
    fit = both.groupBy("y", "x").agg(F.regr_slope("vy", "vx").alias("hedge_ratio"),
                                     F.regr_intercept("vy", "vx").alias("intercept"))
    df = both.join(fit, ["y", "x"]).withColumn(
        "spread", F.col("vy") - F.col("hedge_ratio") * F.col("vx") - F.col("intercept"))
    part = ["y", "x"]
    z = safe_div(F.col("spread") - avg_full("spread", look_back, part=part),
                 stddev_full("spread", look_back, part=part))
    return df.withColumn("z", z)


def half_life(spread: DataFrame) -> DataFrame:
    """-ln 2 over the slope of the change on the lagged level."""
    part = ["y", "x"]
    df = spread.withColumn("lag", lagged("spread", 1, part))
    df = df.withColumn("step", F.col("spread") - F.col("lag"))
    return df.groupBy("y", "x").agg(F.regr_slope("step", "lag").alias("slope"),
                                    F.count("step").alias("n")).withColumn(
        "half_life", safe_div(F.lit(-math.log(2)), "slope"))


def microstructure(quotes: DataFrame) -> DataFrame:
    """Book imbalance, spread in basis points, trade flow and deviation from the traded mean."""
    mid = (F.col("bid_price") + F.col("ask_price")) / 2
    return quotes.select(
        "symbol", "date",
        ((F.col("bid_vol") - F.col("ask_vol")) / (F.col("bid_vol") + F.col("ask_vol") + F.lit(1e-10)))
        .alias("book_imbalance"),
        ((F.col("ask_price") - F.col("bid_price")) / mid * 10000).alias("spread_bps"),
        (F.col("buy_volume") - F.col("sell_volume")).alias("trade_flow"),
        (F.col("close") / F.col("vwap") - 1).alias("vwap_deviation"))
