"""State-space filters, one task per series; a series is bounded by the calendar."""
from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gains(noise: float, drift: float) -> list[float]:
    """Kalman gains of a local level from a first variance of 1, until they stand still."""
    variance, out = 1.0, []
    while len(out) < 2 or out[-1] != out[-2]:
        variance += drift if out else 0.0
        out.append(variance / (variance + noise))
        variance *= 1 - out[-1]
        if len(out) == 4096:
            break
    return out


def local_level(bars: DataFrame, noise: float = 1.0, drift: float = 0.01) -> DataFrame:
    """Filtered level per symbol: level += gain (close - level), from the first close.

    Gains do not depend on the data, so each step is an affine map of the level before, and a series is a scan of such maps:
    inside a block the level is a running sum weighted by the product of what each step keeps; a block is so long that of all
    before the block ahead less than double precision is left. Windows on one partitioning, no Python.
    """
    steps = gains(noise, drift)
    kept = 1 - steps[-1]
    size = max(len(steps), math.ceil(30 * math.log(10) / -math.log(kept)))
    logs = [0.0, *itertools.accumulate(math.log1p(-g) for g in steps[1:])]
    table, weights = F.array(*[F.lit(g) for g in steps]), F.array(*[F.lit(x) for x in logs])
    order = Window.partitionBy("symbol").orderBy("date")
    df = bars.select("symbol", "date", "close").withColumn("_n", F.row_number().over(order) - 1)
    df = df.withColumn("_block", F.floor(F.col("_n") / size)).withColumn("_pos", F.col("_n") % size)
    # what is left of the level at a block's first row, after this row; the first block starts from the first close
    head = F.col("_block") == 0
    last = F.lit(len(steps) - 1)
    gain = F.when(F.col("_n") == 0, 1.0).when(head, F.get(table, F.least(F.col("_pos"), last))).otherwise(steps[-1])
    left = F.when(head, F.get(weights, F.least(F.col("_pos"), last)) + F.greatest(F.col("_pos") - last, F.lit(0)) * math.log(kept)).otherwise((F.col("_pos") + 1) * math.log(kept))
    df = df.withColumn("_gain", gain).withColumn("_left", left)
    inside = Window.partitionBy("symbol", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_local", F.exp("_left") * F.sum(F.col("_gain") * F.col("close") * F.exp(-F.col("_left"))).over(inside))
    carry = F.last(F.when(F.col("_pos") == size - 1, F.col("_local")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    level = F.col("_local") + F.when(head, 0.0).otherwise(F.exp("_left") * carry)
    return df.select("symbol", "date", level.alias("level"))


def dynamic_hedge(pairs: DataFrame, delta: float = 1e-5) -> DataFrame:
    """Time-varying intercept and slope of vy on vx per pair (y, x)."""
    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        state, cov = np.zeros(2), np.ones((2, 2))
        step = delta / (1 - delta) * np.eye(2)
        slopes = []
        for i, (vy, vx) in enumerate(zip(pdf["vy"], pdf["vx"])):
            if i:
                cov = cov + step
            h = np.array([1.0, vx])
            gain = cov @ h / (h @ cov @ h + 1.0)
            state = state + gain * (vy - h @ state)
            cov = cov - np.outer(gain, h) @ cov
            slopes.append(state[1])
        return pdf[["y", "x", "date"]].assign(hedge_ratio=slopes, spread=pdf["vy"] - np.array(slopes) * pdf["vx"])
    return pairs.groupBy("y", "x").applyInPandas(
        track, "y string, x string, date date, hedge_ratio double, spread double")
