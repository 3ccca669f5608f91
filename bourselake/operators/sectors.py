"""Sector membership joins, constituent metrics, sector aggregates and relative strength."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import avg_full, lagged, running, safe_div, yes
from bourselake.operators.indicators import (
    YEAR, bar_number, change, drawdown, rolling_median, sma, with_absorption,
)
from bourselake.operators.universe import overbought_label

MIN_BARS = 200


def constituent_metrics(bars: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """One row per symbol with at least `min_bars` bars."""
    df = (bars.withColumn("_dev", safe_div(F.col("close") - sma("close", 25), sma("close", 25)))
          .withColumn("_50", sma("close", 50)).withColumn("_200", sma("close", 200))
          .withColumn("_r20", change("close", 20)).withColumn("_dd", drawdown())
          .withColumn("_vr", safe_div("volume", rolling_median("volume", 20))))
    df = with_absorption(df)
    last = F.max_by(F.struct("close", "_50", "_200", "_r20", "_dev", "_vr", "absorption"), "date")
    per = df.groupBy("symbol").agg(
        F.count("close").alias("n_bars"), last.alias("r"), F.min_by("close", "date").alias("_a"),
        F.min("_dd").alias("max_drawdown"), F.avg("delivery_pct").alias("avg_delivery_pct"),
        F.avg("_dev").alias("_m"), F.stddev_samp("_dev").alias("_s"),
        F.max_by("delivery_pct", F.when(F.col("delivery_pct").isNotNull(), F.col("date")))
        .alias("delivery_recent"))
    close = F.col("r.close")
    return per.filter(F.col("n_bars") >= min_bars).select(
        "symbol", "n_bars", close.alias("last"), F.col("r._50").alias("ma50"),
        F.col("r._200").alias("ma200"),
        yes((close > F.col("r._50")) & (F.col("r._50") > F.col("r._200"))).alias("uptrend"),
        F.col("r._r20").alias("ret_20d"), (close / F.col("_a") - 1).alias("ret_window"),
        (F.pow(close / F.col("_a"), F.lit(float(YEAR)) / F.col("n_bars")) - 1).alias("cagr"),
        "max_drawdown", "avg_delivery_pct", F.col("r._dev").alias("dist_25dma"),
        safe_div(F.col("r._dev") - F.col("_m"), F.col("_s")).alias("dist_25dma_z"),
        F.col("r._vr").alias("vol_ratio"), "delivery_recent", F.col("r.absorption").alias("absorption"))


def sector_aggregate(metrics: DataFrame, constituents: DataFrame, high: float = 0.80,
                     low: float = 0.20) -> DataFrame:
    """Share in uptrend, mean 20-bar return and status; sectors without data read 0 and null."""
    joined = constituents.join(metrics.select("symbol", "uptrend", "ret_20d"), "symbol", "left")
    agg = joined.groupBy("sector").agg(
        F.coalesce(F.avg(F.col("uptrend").cast("int")), F.lit(0.0)).alias("ratio"),
        F.avg("ret_20d").alias("momentum_20d"), F.count("uptrend").alias("n"))
    return (agg.withColumn("trend", F.when(F.col("ratio") >= 0.5, "up").otherwise("down"))
            .withColumn("status", overbought_label("ratio", high, low)))


def sector_index(bars: DataFrame, constituents: DataFrame) -> DataFrame:
    """Equal-weight index of log returns per sector."""
    step = bars.select("symbol", "date", F.ln(safe_div("close", lagged("close"))).alias("lr"))
    daily = (step.filter("lr IS NOT NULL").join(constituents, "symbol")
             .groupBy("sector", "date").agg(F.avg("lr").alias("lr")))
    return daily.select("sector", "date", (F.lit(100.0) * F.exp(
        F.sum("lr").over(running("sector")))).alias("close"))


def relative_strength(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Both rebased to 100 on the first shared date, and their ratio."""
    both = index.join(benchmark.select("date", F.col("close").alias("bench")), "date")
    w = running("sector")
    both = both.withColumn("sector_norm", F.col("close") / F.first("close").over(w) * 100)
    both = both.withColumn("bench_norm", F.col("bench") / F.first("bench").over(w) * 100)
    return both.withColumn("rel", F.col("sector_norm") / F.col("bench_norm") * 100)


def window_return(df: DataFrame, key: str, out: str) -> DataFrame:
    return df.groupBy(key).agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias(out))


def ranked(df: DataFrame, by: Column, tie: str, out: str = "rank",
           part: list[str] | None = None) -> DataFrame:
    """Dense positions 1..n; without `part` the table must be a per-symbol or per-sector summary."""
    w = Window.partitionBy(*(part or [])).orderBy(by, F.col(tie))
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def monthly_ratio(numerator: DataFrame, denominator: DataFrame) -> DataFrame:
    """Ratio of two monthly series on the shared months, zero denominators left out."""
    a = numerator.select("symbol", "month", F.col("close").alias("num"))
    b = denominator.select("month", F.col("close").alias("den")).filter("den <> 0")
    return a.join(b, "month").withColumn("ratio", F.col("num") / F.col("den"))


def seasonality(monthly: DataFrame, least: int = 6, mean_min: float = 0.025,
                win_min: float = 0.6) -> DataFrame:
    """Month-of-year statistics per symbol and the filters of the seasonal screen."""
    w = Window.partitionBy("symbol").orderBy("month")
    ret = F.try_divide("close", F.lag("close").over(w)) - 1
    df = monthly.select("symbol", "month", ret.alias("r"))
    return df.groupBy("symbol", F.month("month").alias("month_num")).agg(
        F.avg("r").alias("mean_ret"), F.count("r").alias("sample_count"),
        F.avg((yes(F.col("r") > 0)).cast("int")).alias("win_rate")).withColumn(
        "selected", yes((F.col("sample_count") >= least) & (F.col("mean_ret") >= mean_min)
                        & (F.col("win_rate") >= win_min)))


def dislocation_breadth(df: DataFrame, entry: float) -> DataFrame:
    """Share of names per date whose score is below entry, null scores left out, 0 if none."""
    return df.groupBy("date").agg(F.coalesce(F.try_divide(
        F.count_if(F.col("dev_z") < entry), F.count("dev_z")), F.lit(0.0)).alias("dislocation"))


def with_dislocation(df: DataFrame, score: str, entry: float) -> DataFrame:
    """The same share on every row of its date, without a second pass over the scores."""
    day = Window.partitionBy("date")
    return df.withColumn("dislocation", F.coalesce(F.try_divide(
        F.count_if(F.col(score) < entry).over(day), F.count(score).over(day)), F.lit(0.0)))


def realized_vol(returns: DataFrame, dates: DataFrame, benchmark: str) -> DataFrame:
    """20 and 60-date population volatility of a benchmark, else of the market's mean return."""
    recent = returns.join(dates, "date").filter("ret_1d IS NOT NULL")
    daily = recent.groupBy("date", "ago").agg(
        F.avg("ret_1d").alias("mkt"),
        F.max(F.when(F.col("symbol") == benchmark, F.col("ret_1d"))).alias("bench"))
    position = F.row_number().over(Window.orderBy(F.desc("date")))
    daily = daily.withColumn("k", position)
    year = F.lit(float(YEAR) ** 0.5)

    def dev(c: str, cond: Column, least: int) -> Column:
        v = F.when(cond, F.col(c))
        return F.when(F.count(v) >= least, F.stddev_pop(v) * year)
    one = daily.agg(dev("bench", F.col("ago") <= 20, 10).alias("b20"),
                    dev("bench", F.col("ago") <= 60, 20).alias("b60"),
                    F.count("mkt").alias("n"),
                    dev("mkt", F.col("k") <= 20, 1).alias("m20"), dev("mkt", F.lit(True), 1).alias("m60"))
    use_market = (F.col("b20").isNull() | F.col("b60").isNull() | (F.col("b60") == 0)) & (F.col("n") >= 20)
    one = one.select(F.when(use_market, F.col("m20")).otherwise(F.col("b20")).alias("rv20"),
                     F.when(use_market, F.col("m60")).otherwise(F.col("b60")).alias("rv60"))
    return one.withColumn("vol_trend", safe_div("rv20", "rv60"))


def with_bar_stats(df: DataFrame) -> DataFrame:
    return df.withColumn("rn", bar_number()).withColumn("v20", avg_full("volume", 20))
