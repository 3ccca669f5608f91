"""Small expressions: everything here stays inside generated JVM code."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- rounding: floor with a small excess, the same value on every engine ---------------------
def _rounded(c, scale: float) -> Column:
    return F.floor(_col(c) * F.lit(scale) + F.lit(0.50001)) / F.lit(scale)


def r2(c) -> Column:
    return _rounded(c, 100.0)


def r4(c) -> Column:
    return _rounded(c, 10000.0)


def r6(c) -> Column:
    return _rounded(c, 1000000.0)


# -- null handling ---------------------------------------------------------------------------
def safe_div(num, den) -> Column:
    """Null on a zero or null denominator."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def yes(cond: Column) -> Column:
    """A comparison with a null counts as not met."""
    return F.coalesce(cond, F.lit(False))


def bool_int(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def clamp(c, low: float = 0.0, high: float = 1.0) -> Column:
    """Clip into [low, high]; null stays null (least and greatest skip nulls)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


# -- windows on the long bar table -----------------------------------------------------------
def _by(part, order) -> WindowSpec:
    return Window.partitionBy(*([part] if isinstance(part, str) else part)).orderBy(
        *([order] if isinstance(order, (str, Column)) else order))


def trailing(n: int, part="symbol", order="date") -> WindowSpec:
    """The last n rows, current one included."""
    return _by(part, order).rowsBetween(-(n - 1), 0)


def running(part="symbol", order="date") -> WindowSpec:
    """From the first row to the current one."""
    return _by(part, order).rowsBetween(Window.unboundedPreceding, 0)


def lagged(c, n: int = 1, part="symbol", order="date") -> Column:
    """Value n rows back; a negative n looks forward."""
    w = _by(part, order)
    return F.lag(_col(c), n).over(w) if n >= 0 else F.lead(_col(c), -n).over(w)


def _when_full(agg: Column, c, w: WindowSpec, at_least: int) -> Column:
    return F.when(F.count(_col(c)).over(w) >= at_least, agg)


def avg_full(c, n: int, at_least: int | None = None, part="symbol", order="date") -> Column:
    w = trailing(n, part, order)
    return _when_full(F.avg(_col(c)).over(w), c, w, n if at_least is None else at_least)


def sum_full(c, n: int, at_least: int | None = None, part="symbol", order="date") -> Column:
    w = trailing(n, part, order)
    return _when_full(F.sum(_col(c)).over(w), c, w, n if at_least is None else at_least)


def stddev_full(c, n: int, at_least: int | None = None, population: bool = False,
                part="symbol", order="date") -> Column:
    w = trailing(n, part, order)
    std = F.stddev_pop if population else F.stddev_samp
    return _when_full(std(_col(c)).over(w), c, w, n if at_least is None else at_least)


def with_moving_z(df: DataFrame, c: str, out: str, n: int, at_least: int, population: bool,
                  part="symbol", order="date") -> DataFrame:
    """Score of each value against the mean and deviation of its last n rows.

    Both come from running sums and their values n rows back: constant work per row whatever the
    frame. Meant for ratios and returns, whose squares keep their digits when summed.
    """
    x = F.coalesce(_col(c), F.lit(0.0))
    up, w = running(part, order), _by(part, order)
    df = df.withColumn("_r", F.struct(
        F.sum(x).over(up).alias("s"), F.sum(x * x).over(up).alias("q"), F.count(_col(c)).over(up).cast("double").alias("k")))
    df = df.withColumn("_o", F.lag("_r", n).over(w))

    def moved(name: str) -> Column:
        return F.col(f"_r.{name}") - F.coalesce(F.col(f"_o.{name}"), F.lit(0.0))
    k = moved("k")
    mean = moved("s") / k
    var = (moved("q") - moved("s") * mean) / (k if population else k - 1)
    z = (_col(c) - mean) / F.sqrt(var)
    return df.withColumn(out, F.when((k >= at_least) & (var > 1e-18), z)).drop("_r", "_o")


# -- scoring ---------------------------------------------------------------------------------
def bands(c, steps: Sequence[tuple[float, object]], otherwise, strict: bool = False) -> Column:
    """First step whose threshold the value reaches, steps in descending order."""
    c = _col(c)
    expr = None
    for threshold, label in steps:
        hit = c > F.lit(threshold) if strict else c >= F.lit(threshold)
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return F.when(c.isNotNull(), expr.otherwise(F.lit(otherwise)))


def interp(c, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear through ascending (x, y) knots, flat outside."""
    c = _col(c)
    expr = F.when(c <= F.lit(float(knots[0][0])), F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        line = F.lit(float(y0)) + (c - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0))
        expr = expr.when(c <= F.lit(float(x1)), line)
    return F.when(c.isNotNull(), expr.otherwise(F.lit(float(knots[-1][1]))))


# -- normal distribution ---------------------------------------------------------------------
# Coefficients of the published rational approximation 26.2.17.
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def norm_pdf(c) -> Column:
    c = _col(c)
    return F.exp(-c * c / F.lit(2.0)) / F.lit(math.sqrt(2 * math.pi))


def norm_cdf(c) -> Column:
    c = _col(c)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * F.abs(c))
    poly = F.lit(0.0)
    for b in reversed(CDF_B):
        poly = t * (F.lit(b) + poly)
    tail = norm_pdf(F.abs(c)) * poly
    return F.when(c >= 0, F.lit(1.0) - tail).otherwise(tail)
