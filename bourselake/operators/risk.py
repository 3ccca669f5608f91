"""Return and risk summaries per series."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import lagged, running, safe_div
from bourselake.operators.indicators import YEAR, drawdown


def drawdown_periods(bars: DataFrame, k: int = 5) -> DataFrame:
    """Worst drawdown episodes per symbol; an episode starts at each new running high."""
    df = bars.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    df = df.filter("rn > 1").withColumn("dd", drawdown())
    df = df.withColumn("episode", F.sum((F.col("dd") == 0).cast("bigint")).over(running()))
    low = df.groupBy("symbol", "episode").agg(
        F.min("dd").alias("depth"), F.min("date").alias("start"), F.count("*").alias("length"))
    w = Window.partitionBy("symbol").orderBy("depth", "episode")
    return low.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def risk_metrics(bars: DataFrame, annual_rate: float = 0.06) -> DataFrame:
    """Annual return and volatility, Sharpe, Sortino, Calmar, VaR and expected shortfall."""
    r = safe_div("close", lagged("close")) - 1
    df = bars.withColumn("r", r).withColumn("dd", drawdown()).filter("r IS NOT NULL")
    daily, year = annual_rate / YEAR, float(YEAR)
    excess = F.col("r") - F.lit(daily)
    below = F.least(excess, F.lit(0.0))
    one = df.groupBy("symbol").agg(
        F.count("r").alias("n"), F.sum(F.ln(F.col("r") + 1)).alias("lg"), F.avg("r").alias("m"),
        F.stddev_samp("r").alias("sd"), F.avg(excess).alias("me"),
        F.sqrt(F.avg(below * below)).alias("down"), F.min("dd").alias("mdd"),
        F.percentile("r", F.lit(0.05)).alias("var_95"), F.percentile("r", F.lit(0.01)).alias("var_99"))
    tail = (df.join(one.select("symbol", "var_95"), "symbol").filter(F.col("r") <= F.col("var_95"))
            .groupBy("symbol").agg(F.avg("r").alias("cvar_95")))
    ann = F.exp(F.col("lg") * F.lit(year) / F.col("n")) - 1
    root = F.lit(math.sqrt(year))
    return one.join(tail, "symbol", "left").select(
        "symbol", ann.alias("annual_return"), (F.col("sd") * root).alias("annual_vol"),
        (safe_div("me", "sd") * root).alias("sharpe"), (safe_div("me", "down") * root).alias("sortino"),
        safe_div(ann, F.abs("mdd")).alias("calmar"), F.col("mdd").alias("max_drawdown"),
        "var_95", "var_99", "cvar_95")


def portfolio_risk(covariances: DataFrame, weights: DataFrame) -> DataFrame:
    """Portfolio volatility and each name's marginal contribution, from a pair table a <= b."""
    year = F.lit(float(YEAR))
    both = covariances.select("a", "b", "cov").unionByName(
        covariances.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    w = weights.select(F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    per = both.join(w, "b").groupBy(F.col("a").alias("symbol")).agg(
        (F.sum(F.col("cov") * F.col("wb")) * year).alias("cw"))
    per = per.join(weights, "symbol")
    vol = per.agg(F.sqrt(F.sum(F.col("cw") * F.col("weight")))).scalar()
    return per.withColumn("portfolio_vol", vol).withColumn(
        "marginal", F.col("cw") / F.col("portfolio_vol")).drop("cw")
