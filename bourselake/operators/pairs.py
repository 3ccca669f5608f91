"""All-pairs statistics without pair rows: symbols are cut into hash blocks, every pair of
blocks is one task, and the moments of a block pair are matrix products inside the task.

A task holds two blocks of series, never the whole universe, and emits one row per pair at most. The
number of blocks follows the universe: BLOCK names each on average, unless a number is given.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOMENTS = ("a string, b string, n bigint, sx double, sy double, sxx double, syy double, "
           "sxy double")
#: Names per block and row keys per chunk, on average.
BLOCK, CHUNK = 256, 4096


def parts_of(df: DataFrame, name: str, size: int) -> Column:
    """How many parts of `size` the distinct values of a column make, as a scalar subquery; 1 for none."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct(name) / size)).cast("int").alias("n")).scalar()


def _spread_over_blocks(df: DataFrame, value: str, blocks: int | None, split: bool = False) -> DataFrame:
    whole = df
    blocks = F.lit(blocks) if blocks else parts_of(whole, "symbol", BLOCK)
    own = F.pmod(F.xxhash64("symbol"), blocks).cast("int")
    df = df.filter(F.col(value).isNotNull()).select(
        "symbol", "date", F.col(value).cast("double").alias("v"), own.alias("own"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    chunk = F.pmod(F.xxhash64("date"), parts_of(whole, "date", CHUNK)).cast("int") if split else F.lit(0)
    return (df.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
            .withColumn("chunk", chunk))


def _matrices(pdf: pd.DataFrame):
    p, q = pdf["p"].iat[0], pdf["q"].iat[0]
    wide = pdf.pivot(index="date", columns="symbol", values="v").sort_index()
    owner = pdf.drop_duplicates("symbol").set_index("symbol")["own"]
    left = [s for s in wide.columns if owner[s] == p]
    right = [s for s in wide.columns if owner[s] == q]
    return wide, left, right


def pair_moments(df: DataFrame, value: str, blocks: int | None = None, with_self: bool = False, split: bool = False) -> DataFrame:
    """Counts, sums and cross products over shared dates for every pair a < b (or a <= b).

    With `split` the rows of a block pair are split by hash into chunks as well, and the partial moments
    of a pair are added up; use it where the row axis is not a calendar.
    """
    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, left, right = _matrices(pdf)
        x, y = wide[left].to_numpy(), wide[right].to_numpy()
        mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        grids = [mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y]
        names_l, names_r = np.array(left, object), np.array(right, object)
        i, j = np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij")
        a, b = names_l[i.ravel()], names_r[j.ravel()]
        n, sx, sy, sxx, syy, sxy = (g.ravel() for g in grids)
        same_block = pdf["p"].iat[0] == pdf["q"].iat[0]
        keep = (n > 0) & ((a <= b) if with_self else (a != b))
        if same_block:
            keep &= a <= b
        swap = a > b
        out = pd.DataFrame({
            "a": np.where(swap, b, a), "b": np.where(swap, a, b), "n": n.astype("int64"),
            "sx": np.where(swap, sy, sx), "sy": np.where(swap, sx, sy),
            "sxx": np.where(swap, syy, sxx), "syy": np.where(swap, sxx, syy), "sxy": sxy})
        if with_self and not same_block:
            keep = n > 0
        return out[keep]

    parts = _spread_over_blocks(df, value, blocks, split).groupBy("p", "q", "chunk").applyInPandas(gram, MOMENTS)
    if not split:
        return parts
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def with_correlation(moments: DataFrame, least: int = 2) -> DataFrame:
    """Pearson correlation and sample covariance from the moments; null on zero variance."""
    n = F.col("n").cast("double")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    ok = (F.col("n") >= least) & (vx > 0) & (vy > 0)
    return (moments.withColumn("corr", F.when(ok, cov / F.sqrt(vx * vy)))
            .withColumn("cov", F.when(F.col("n") > 1, F.try_divide(cov, n - 1))))


def last_dates(df: DataFrame, n: int, target) -> DataFrame:
    """The last n calendar dates up to `target` (a column), numbered 1 = latest.

    One row per calendar date enters the unpartitioned window.
    """
    dates = df.filter(F.col("date") <= target).select("date").distinct()
    rank = F.row_number().over(Window.orderBy(F.desc("date")))
    return dates.withColumn("ago", rank).filter(F.col("ago") <= n)


def average_pair_correlation(returns: DataFrame, blocks: int | None = None, least: int = 5) -> DataFrame:
    """Mean off-diagonal correlation over the given dates, pairs sharing at least `least`."""
    pairs = with_correlation(pair_moments(returns, "ret_1d", blocks), least)
    return pairs.agg(F.avg("corr").alias("avg_pair_corr"), F.count("corr").alias("n_pairs"))


SPREAD = ("a string, b string, n bigint, hedge_ratio double, intercept double, half_life double, "
          "df_t double")


def pair_spread_stats(df: DataFrame, value: str, blocks: int | None = None, least: int = 60) -> DataFrame:
    """Hedge ratio of a on b, half-life of the spread and its Dickey-Fuller t statistic."""
    def stats(pdf: pd.DataFrame) -> pd.DataFrame:
        wide, left, right = _matrices(pdf)
        same = pdf["p"].iat[0] == pdf["q"].iat[0]
        rows = []
        for one in left:
            for two in right:
                if one == two or (same and one > two):
                    continue
                a, b = min(one, two), max(one, two)
                both = wide[[a, b]].dropna().to_numpy()
                if len(both) < least:
                    continue
                y, x = both[:, 0], both[:, 1]
                beta = np.cov(x, y)[0, 1] / np.var(x, ddof=1)
                alpha = y.mean() - beta * x.mean()
                spread = y - beta * x - alpha
                lag, step = spread[:-1], np.diff(spread)
                sxx = ((lag - lag.mean()) ** 2).sum()
                slope = ((lag - lag.mean()) * (step - step.mean())).sum() / sxx
                resid = step - step.mean() - slope * (lag - lag.mean())
                se = math.sqrt((resid ** 2).sum() / (len(lag) - 2) / sxx)
                rows.append((a, b, len(both), beta, alpha,
                             -math.log(2) / slope if slope else None, slope / se))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in SPREAD.split(", ")])

    return _spread_over_blocks(df, value, blocks).groupBy("p", "q").applyInPandas(stats, SPREAD)
