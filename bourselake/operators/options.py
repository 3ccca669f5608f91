"""Option values, Greeks, implied volatility and strategy payoffs as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import norm_cdf, norm_pdf


def _d1(s, k, t, sigma, r, q) -> Column:
    return (F.ln(s / k) + (r - q + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))


def value(s, k, t, sigma, r, q, is_call) -> Column:
    d1 = _d1(s, k, t, sigma, r, q)
    d2 = d1 - sigma * F.sqrt(t)
    fwd, disc = s * F.exp(-q * t), k * F.exp(-r * t)
    call = fwd * norm_cdf(d1) - disc * norm_cdf(d2)
    return F.when(is_call, call).otherwise(call - fwd + disc)


def price_quotes(quotes: DataFrame) -> DataFrame:
    """Value and five Greeks of quotes(spot, strike, years, sigma, rate, carry, is_call).

    Theta is per calendar day, vega and rho per one percent.
    """
    s, k, t, v, r, q = (F.col(c) for c in ("spot", "strike", "years", "sigma", "rate", "carry"))
    df = quotes.withColumn("d1", _d1(s, k, t, v, r, q))
    df = df.withColumn("d2", F.col("d1") - v * F.sqrt(t)).withColumn("n1", norm_cdf(F.col("d1"))).withColumn(
        "n2", norm_cdf(F.col("d2"))).withColumn("density", norm_pdf(F.col("d1")))
    call, fwd, disc = F.col("is_call"), s * F.exp(-q * t), k * F.exp(-r * t)
    n1, n2 = F.col("n1"), F.col("n2")
    decay = -fwd * F.col("density") * v / (F.lit(2.0) * F.sqrt(t))
    carry = F.when(call, q * fwd * n1 - r * disc * n2).otherwise(r * disc * (F.lit(1.0) - n2) - q * fwd * (F.lit(1.0) - n1))
    worth = F.when(call, fwd * n1 - disc * n2).otherwise(disc * (F.lit(1.0) - n2) - fwd * (F.lit(1.0) - n1))
    return (df.withColumn("value", worth)
            .withColumn("delta", F.exp(-q * t) * F.when(call, n1).otherwise(n1 - 1))
            .withColumn("gamma", F.exp(-q * t) * F.col("density") / (s * v * F.sqrt(t)))
            .withColumn("theta", (decay + carry) / 365)
            .withColumn("vega", fwd * F.col("density") * F.sqrt(t) / 100)
            .withColumn("rho", F.when(call, disc * t * n2).otherwise(-disc * t * (F.lit(1.0) - n2)) / 100)
            .drop("n1", "n2", "density"))


def implied_vol(quotes: DataFrame, low: float = 0.001, high: float = 5.0, steps: int = 60) -> DataFrame:
    """Bisection with a fixed number of steps; prices outside the reachable range are null."""
    args = [F.col(c) for c in ("rate", "carry", "is_call")]

    def at(sigma: Column) -> Column:
        return value(F.col("spot"), F.col("strike"), F.col("years"), sigma, *args)
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        over = at(mid) > F.col("price")
        return F.struct(F.when(over, state["lo"]).otherwise(mid).alias("lo"), F.when(over, mid).otherwise(state["hi"]).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    reachable = (F.col("price") >= at(F.lit(low))) & (F.col("price") <= at(F.lit(high)))
    return quotes.withColumn("implied_vol", F.when(reachable, found))


def payoff_curve(legs: DataFrame, points: int = 41, margin: float = 0.10) -> DataFrame:
    """Profit per strategy and price point at expiry: legs(strategy, underlying, option_type,
    side +1/-1, strike, premium, quantity, lot_size)."""
    low = F.col("underlying") * (1 - margin)
    step = F.col("underlying") * (2 * margin) / (points - 1)
    grid = legs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("spot", low + F.col("i") * step)
    worth = F.when(F.col("option_type") == "call", F.greatest(F.col("spot") - F.col("strike"), F.lit(0.0))).otherwise(
        F.greatest(F.col("strike") - F.col("spot"), F.lit(0.0)))
    gain = F.col("side") * (worth - F.col("premium")) * F.col("quantity") * F.col("lot_size")
    return grid.groupBy("strategy", "i").agg(F.max("spot").alias("spot"), F.sum(gain).alias("pl"))


def strategy_summary(legs: DataFrame, points: int = 41) -> DataFrame:
    """Net premium, extreme profits and interpolated break-even prices per strategy."""
    net = legs.groupBy("strategy").agg(F.sum(
        F.col("side") * F.col("premium") * F.col("quantity") * F.col("lot_size")).alias("net_premium"))
    w = Window.partitionBy("strategy").orderBy("i")
    curve = payoff_curve(legs, points).withColumn("p0", F.lag("pl").over(w)).withColumn("s0", F.lag("spot").over(w))
    share = F.abs("p0") / F.abs(F.col("pl") - F.col("p0"))
    even = F.when(F.col("p0") * F.col("pl") < 0, F.col("s0") + share * (F.col("spot") - F.col("s0"))).when(
        F.abs("pl") < 0.01, F.col("spot"))
    # at most one break-even per grid step, so the list is bounded by the number of points
    out = curve.withColumn("even", even).groupBy("strategy").agg(
        F.max("pl").alias("max_profit"), F.min("pl").alias("max_loss"), F.count("even").alias("n_breakevens"),
        F.min("even").alias("first_breakeven"))
    return out.join(net, "strategy")


def iv_rv_features(quotes: DataFrame, realized: DataFrame, nearest: int = 3) -> DataFrame:
    """Put/call ratio, at-the-money volatility of the nearest call strikes, and its premium."""
    ratio = quotes.groupBy("symbol", "date").agg(
        (F.count_if(~F.col("is_call")) / (F.count_if("is_call") + 1)).alias("put_call_ratio"))
    w = Window.partitionBy("symbol", "date").orderBy(F.abs(F.col("strike") - F.col("spot")), "strike")
    atm = (quotes.filter("is_call").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= nearest)
           .groupBy("symbol", "date").agg(F.avg("sigma").alias("atm_iv")))
    return ratio.join(atm, ["symbol", "date"], "left").join(realized, ["symbol", "date"], "left").withColumn(
        "iv_rv_spread", F.col("atm_iv") - F.col("realized_vol"))
