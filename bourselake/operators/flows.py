"""Institutional flow totals and regimes, one row per date."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import avg_full, running, sum_full

# Significance thresholds (daily, month to date, year to date) in crores.
SIGNIFICANCE = {"daily": (1000.0, 2000.0, 5000.0), "mtd": (5000.0, 10000.0, 25000.0),
                "ytd": (25000.0, 50000.0, 100000.0)}


def net_by_date(flows: DataFrame, unit: float = 1.0) -> DataFrame:
    """Foreign and domestic net per date, absent categories as zero."""
    net = (F.col("buy_value") - F.col("sell_value")) / F.lit(unit)

    def side(name: str) -> Column:
        return F.sum(F.when(F.col("category") == name, net).otherwise(0.0))
    return flows.groupBy("date").agg(side("FII").alias("fii"), side("DII").alias("dii"))


def flow_totals(net: DataFrame) -> DataFrame:
    """10-day, month-to-date and year-to-date nets, ratio and absorption rate.

    One row per calendar date; the unpartitioned 10-day window is bounded by the calendar.
    """
    month = net.withColumn("_m", F.trunc("date", "MM")).withColumn("_y", F.trunc("date", "YYYY"))
    for side in ("fii", "dii"):
        month = (month.withColumn(f"{side}_10d", sum_full(side, 10, 1, [], "date"))
                 .withColumn(f"{side}_mtd", F.sum(side).over(running("_m")))
                 .withColumn(f"{side}_ytd", F.sum(side).over(running("_y"))))
    return (month.withColumn("ratio", F.try_divide("fii", "dii"))
            .withColumn("absorption_rate", F.when(F.col("fii") < 0, F.col("dii") / F.abs("fii")))
            .drop("_m", "_y"))


def significance(c, horizon: str) -> Column:
    minor, moderate, significant = SIGNIFICANCE[horizon]
    size = F.abs(F.col(c) if isinstance(c, str) else c)
    return (F.when(size < minor, "Minor").when(size < moderate, "Moderate")
            .when(size <= significant, "Significant").otherwise("Major"))


def _streak(cond: str) -> Column:
    """Consecutive rows up to here for which `cond` holds (rows numbered by `_k`)."""
    last_break = F.max(F.when(~F.col(cond), F.col("_k"))).over(running([], "date"))
    return F.col("_k") - F.coalesce(last_break, F.lit(0))


def flow_regime(totals: DataFrame, run: int = 5, absorbed: float = 0.70, mtd: float = 5000.0
                ) -> DataFrame:
    """Regime label, run lengths and acceleration (last five days against the five before)."""
    df = totals.withColumn("_k", F.row_number().over(Window.orderBy("date")))
    df = (df.withColumn("_fb", F.col("fii") > 0).withColumn("_fs", F.col("fii") < 0)
          .withColumn("_both", (F.col("fii") > 0) & (F.col("dii") > 0)))
    df = (df.withColumn("buy_run", _streak("_fb")).withColumn("sell_run", _streak("_fs"))
          .withColumn("dual_run", _streak("_both")))
    last5 = avg_full("fii", 5, 5, [], "date")
    before = F.lag(F.col("_l5"), 5).over(Window.orderBy("date"))
    df = df.withColumn("_l5", last5).withColumn("accel", F.col("_l5") - before)
    flipped = F.max((F.col("_flip")).cast("int")).over(Window.orderBy("date").rowsBetween(-4, 0)) == 1
    df = df.withColumn("_flip", F.coalesce(
        F.signum("fii") != F.signum(F.lag("fii").over(Window.orderBy("date"))), F.lit(False)))
    regime = (F.when((F.col("fii") < 0) & (F.col("dii") < 0), "Dual Selling")
              .when(F.col("dual_run") >= 3, "Dual Buying")
              .when((F.col("fii") < 0) & (F.col("absorption_rate") > absorbed), "DII Absorption")
              .when((F.col("buy_run") >= run) | (F.col("fii_mtd") > mtd), "FII Net Buyer")
              .when((F.col("sell_run") >= run) | (F.col("fii_mtd") < -mtd), "FII Net Seller")
              .when(flipped, "Transition Phase").otherwise("Neutral"))
    return (df.withColumn("regime", regime).withColumn("significance", significance("fii", "daily"))
            .drop("_k", "_fb", "_fs", "_both", "_l5", "_flip"))
