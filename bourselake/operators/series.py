"""Per-symbol summaries and calendar features built on the indicator expressions."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.functions import bool_int, safe_div, stddev_full
from bourselake.operators.indicators import YEAR, change, drawdown


def growth_and_drawdown(bars: DataFrame) -> DataFrame:
    """Annualised growth over bars/252 years, worst drawdown and their ratio, per symbol."""
    stats = bars.withColumn("_dd", drawdown()).groupBy("symbol").agg(
        F.count("close").alias("n_bars"), F.min_by("close", "date").alias("_a"),
        F.max_by("close", "date").alias("_z"), F.min("_dd").alias("max_dd"))
    cagr = F.pow(safe_div("_z", "_a"), F.lit(float(YEAR)) / F.col("n_bars")) - 1
    return stats.withColumn("cagr", cagr).withColumn(
        "calmar", safe_div("cagr", F.abs("max_dd"))).drop("_a", "_z")


def seasonal_interaction(df: DataFrame, proxy: str = "proxy") -> DataFrame:
    """Calendar flags and the products of an outside signal with price features."""
    month, day = F.month("date"), F.weekday("date")
    df = (df.withColumn("month", month.cast("bigint")).withColumn("day_of_week", day.cast("bigint"))
          .withColumn("is_monday", bool_int(day == 0)).withColumn("is_friday", bool_int(day == 4))
          .withColumn("is_fiscal_yearend", bool_int(month == 3))
          .withColumn("_r", change("close"))
          .withColumn("_p", change(proxy, 5)))
    vol = stddev_full("_r", 30) * F.lit(math.sqrt(YEAR))
    return (df.withColumn("signal_x_momentum", F.col("_p") * change("close", 20))
            .withColumn("signal_x_vol", F.col("_p") * vol)
            .withColumn("signal_x_monsoon", F.col("_p") * month.between(6, 9).cast("int")))
