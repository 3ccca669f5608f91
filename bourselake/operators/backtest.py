"""Target-weight backtests on the long table: signals, portfolio returns, statistics.

Everything a bar sees ends at that bar, and a decision is executed on the next one.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import avg_full, bool_int, lagged, norm_cdf, running, safe_div, trailing, yes
from bourselake.operators.indicators import YEAR, bar_number, change, sma, with_bollinger, with_macd, with_rsi

FEES, SLIPPAGE = 13.0 / 1e4, 5.0 / 1e4
ENTRY, EXIT = -1.5, -0.25


# -- targets: a number sets the position, null holds it ------------------------------------------
def reversion_target(z, uptrend: Column, entry: float = ENTRY, exit_: float = EXIT,
                     gate: Column | None = None) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    enter = (z < entry) & uptrend
    if gate is not None:
        enter = enter & gate
    strength = F.least(F.lit(1.0), F.abs(z - entry) / 1.5 + 0.5)
    return F.when(enter, strength).when(z >= exit_, F.lit(0.0))


def window_target(z, entry: float = -2.0) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z <= entry, F.least(F.lit(1.0), F.abs(z) / 3))


def held(target, keys: Sequence[str]) -> Column:
    """Last stated target; a bar without a statement keeps the position."""
    return F.coalesce(F.last(target, ignorenulls=True).over(running(list(keys))), F.lit(0.0))


# -- portfolio -------------------------------------------------------------------------------------
def executed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long-only position of each bar, decided the bar before, with entry and exit flags."""
    series = [*keys, "symbol"]
    w = Window.partitionBy(*series).orderBy("date")
    df = df.withColumn("held", held("target", series))
    df = df.withColumn("pos", F.greatest(F.coalesce(F.lag("held").over(w), F.lit(0.0)), F.lit(0.0)))
    before = F.coalesce(F.lag("pos").over(w), F.lit(0.0))
    return df.withColumn("entry", (F.col("pos") > 0) & (before <= 0)).withColumn(
        "exit", (F.col("pos") <= 0) & (before > 0))


def portfolio_returns(positions: DataFrame, keys: Sequence[str], fees: float = FEES,
                      slippage: float = SLIPPAGE) -> DataFrame:
    """Daily net return per key: weight = position over the number of names held that date."""
    keys = list(keys)
    # the names of one date share a partition for a moment: at most one row per symbol
    names = F.count_if(F.col("pos") > 0).over(Window.partitionBy(*keys, "date"))
    df = positions.withColumn("n_held", names)
    df = df.withColumn("weight", F.coalesce(F.try_divide("pos", "n_held"), F.lit(0.0)))
    prev = F.coalesce(F.lag("weight").over(
        Window.partitionBy(*keys, "symbol").orderBy("date")), F.lit(0.0))
    net = (F.col("weight") * F.coalesce("ret_1d", F.lit(0.0))
           - F.abs(F.col("weight") - prev) * F.lit(fees + slippage))
    return df.withColumn("net", net).groupBy(*keys, "date").agg(
        F.sum("net").alias("ret"), F.max("n_held").alias("n_held"))


def trades(positions: DataFrame, keys: Sequence[str], fees: float = FEES,
           slippage: float = SLIPPAGE) -> DataFrame:
    """One row per holding run with its compounded return after costs on both sides."""
    series = [*keys, "symbol"]
    df = positions.withColumn("run", F.sum(F.col("entry").cast("bigint")).over(running(series)))
    return df.filter("pos > 0").groupBy(*series, "run").agg(
        (F.exp(F.sum(F.ln(F.coalesce("ret_1d", F.lit(0.0)) + 1))) - 1 - 2 * (fees + slippage))
        .alias("pnl"), F.count("*").alias("bars"))


def return_stats(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Growth, Sharpe, Sortino, drawdown and Calmar per key over its daily returns."""
    keys = list(keys)
    log_sum = F.sum(F.ln(F.col("ret") + 1)).over(running(keys, "date"))
    df = daily.withColumn("equity", F.exp(log_sum))
    df = df.withColumn("dd", F.col("equity") / F.greatest(
        F.max("equity").over(running(keys, "date")), F.lit(1.0)) - 1)
    below = F.least("ret", F.lit(0.0))
    year = F.lit(float(YEAR))
    one = df.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.max_by("equity", "date").alias("final"),
        F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"),
        F.sqrt(F.avg(below * below)).alias("down"), F.min("dd").alias("max_drawdown"))
    cagr = F.pow("final", year / F.col("n_days")) - 1
    return one.select(*keys, "n_days", (F.col("final") - 1).alias("total_return"), cagr.alias("cagr"),
                      (safe_div("m", "sd") * F.sqrt(year)).alias("sharpe"),
                      (safe_div("m", "down") * F.sqrt(year)).alias("sortino"), "max_drawdown",
                      safe_div(cagr, F.abs("max_drawdown")).alias("calmar"))


def trade_stats(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    gross = F.sum(F.when(win, F.col("pnl")).otherwise(0.0))
    lost = F.sum(F.when(loss, -F.col("pnl")).otherwise(0.0))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.avg(win.cast("int")).alias("win_rate"),
        F.try_divide(gross, lost).alias("profit_factor"), F.avg("pnl").alias("expectancy"))


def out_of_sample(daily: DataFrame, keys: Sequence[str], fraction: float = 0.3) -> DataFrame:
    """The last share of each key's dates."""
    keys = list(keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    return daily.withColumn("_k", k).withColumn("_n", n).filter(
        F.col("_k") > F.floor(F.col("_n") * F.lit(1 - fraction) + 1e-9)).drop("_k", "_n")


def over_null(stats: DataFrame, null: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sharpe against the null strategy of the same basket, with the verdict."""
    keys = list(keys)
    base = stats.filter(F.col("strategy") == null).select(*keys, F.col("sharpe").alias("null_sharpe"))
    if keys:
        df = stats.join(base, keys)
    else:
        df = stats.withColumn("null_sharpe", base.select("null_sharpe").scalar())
    df = df.filter(F.col("strategy") != null)
    df = df.withColumn("sharpe_over_null", F.col("sharpe") - F.col("null_sharpe"))
    return df.withColumn("verdict", F.when(F.col("sharpe_over_null") > 0, "EDGE").otherwise(
        "no edge over null"))


def deflated_sharpe(sharpe, n_obs, n_trials: int) -> Column:
    """Probability that a Sharpe is real after `n_trials` tries; the Sharpe is made daily first."""
    daily = (F.col(sharpe) if isinstance(sharpe, str) else sharpe) / math.sqrt(YEAR)
    root = F.sqrt((F.col(n_obs) if isinstance(n_obs, str) else n_obs) - F.lit(1.0))
    if n_trials == 1:
        expected = 0.0
    else:
        gamma, normal = 0.5772156649015329, NormalDist()
        expected = ((1 - gamma) * normal.inv_cdf(1 - 1 / n_trials)
                    + gamma * normal.inv_cdf(1 - 1 / (n_trials * math.e)))
    error = F.sqrt(F.lit(1.0) + daily * daily / 2) / root
    return norm_cdf((daily - F.lit(expected) / root) / error)


# -- recipe patterns ------------------------------------------------------------------------------
def crossed(a: str, b: str, above: bool) -> Column:
    """a passes b between the previous bar and this one."""
    pa, pb = lagged(a), lagged(b)
    if above:
        return yes((pa <= pb) & (F.col(a) > F.col(b)))
    return yes((pa >= pb) & (F.col(a) < F.col(b)))


def signal_patterns(bars: DataFrame) -> DataFrame:
    """Entry and exit flags of five classic patterns."""
    df = with_bollinger(with_macd(with_rsi(bars)))
    df = df.withColumn("fast", sma("close", 10)).withColumn("slow", sma("close", 50))
    for level in (30, 70):
        df = df.withColumn(f"l{level}", F.lit(float(level)))
    up, down = crossed("fast", "slow", True), crossed("fast", "slow", False)
    flags = {
        "rsi_entry": crossed("rsi", "l30", False), "rsi_exit": crossed("rsi", "l70", True),
        "macd_entry": crossed("macd", "macd_signal", True), "macd_exit": crossed("macd", "macd_signal", False),
        "bb_entry": yes(F.col("close") < F.col("bb_lower")), "bb_exit": yes(F.col("close") > F.col("bb_upper")),
        "ma_entry": up, "ma_exit": down,
        "combined_entry": up & yes(F.col("rsi") < 60), "combined_exit": down | yes(F.col("rsi") > 80)}
    return df.select("symbol", "date", *[bool_int(c).alias(n) for n, c in flags.items()])


def rolling_walk_forward(bars: DataFrame, windows: Sequence[int] = (5, 10, 15, 20), train: int = 504,
                         test: int = 63, cost: float = 0.001) -> DataFrame:
    """Per symbol and fold: the window with the best training Sharpe, scored on the next bars.

    Slices come from running sums at their two ends, so folds overlap at no extra cost. Windows often hold the same
    positions over a whole slice; the sums are decimals, without rounding, so that these windows have equal Sharpe ratios
    and the shortest one is taken. Equal averages of prices are equal for the same reason: they are no crossing.
    """
    price, kept = F.col("close").cast("decimal(28,10)"), "decimal(24,18)"
    df = bars.withColumn("rn", bar_number()).withColumn("n", F.count("*").over(
        Window.partitionBy("symbol"))).withColumn("r", F.coalesce(change("close"), F.lit(0.0)))
    w = Window.partitionBy("symbol").orderBy("date")
    for size in windows:
        df = df.withColumn("_f", sma(price, size)).withColumn("_s", sma(price, size * 3))
        signal = F.when(crossed("_f", "_s", True), 1.0).when(crossed("_f", "_s", False), 0.0)
        df = df.withColumn("_t", signal).withColumn("_h", held("_t", ["symbol"]))
        df = df.withColumn("_p", F.coalesce(F.lag("_h").over(w), F.lit(0.0)))
        moved = F.abs(F.col("_p") - F.coalesce(F.lag("_p").over(w), F.lit(0.0)))
        df = df.withColumn("_x", F.col("_p") * F.col("r") - moved * cost)
        df = df.withColumn(f"s{size}", F.sum(F.col("_x").cast(kept)).over(running())).withColumn(
            f"q{size}", F.sum((F.col("_x") * F.col("_x")).cast(kept)).over(running())).withColumn(
            f"g{size}", F.sum(F.ln(F.col("_x") + 1)).over(running()))
    slices = {}
    for size in windows:
        for name in ("s", "q", "g"):
            c = f"{name}{size}"
            start = F.coalesce(F.lag(c, train).over(w), F.lit(0))
            slices[f"a_{c}"] = (F.col(c) - start).cast("double")
            slices[f"b_{c}"] = (F.lead(c, test).over(w) - F.col(c)).cast("double")
    df = df.select("symbol", "date", "rn", "n", F.lead("date", 1).over(w).alias("test_start"),
                   *[v.alias(k) for k, v in slices.items()])
    folds = df.filter((F.col("rn") >= train) & ((F.col("rn") - train) % test == 0)
                      & (F.col("rn") + test < F.col("n")))

    def sharpe(p: str, size: int, n: int) -> Column:
        mean = F.col(f"{p}_s{size}") / n
        var = (F.col(f"{p}_q{size}") - F.col(f"{p}_s{size}") * mean) / (n - 1)
        return F.when(var > 1e-18, mean / F.sqrt(var) * math.sqrt(YEAR))
    choices = F.array(*[F.struct(F.coalesce(sharpe("a", s, train), F.lit(-999.0)).alias("train_sharpe"),
                                 F.lit(-s).alias("order"), F.lit(s).alias("best_window"),
                                 sharpe("b", s, test).alias("test_sharpe"),
                                 (F.exp(f"b_g{s}") - 1).alias("test_return")) for s in windows])
    best = F.array_max(choices)
    return folds.withColumn("best", best).select(
        "symbol", "test_start", F.col("best.best_window").cast("bigint").alias("best_window"),
        F.col("best.train_sharpe").alias("train_sharpe"), F.col("best.test_return").alias("test_return"),
        F.col("best.test_sharpe").alias("test_sharpe"))


def sector_momentum(bars: DataFrame, constituents: DataFrame, n: int = 63) -> DataFrame:
    """Best sector per date by the mean n-bar return of its members."""
    mom = bars.select("symbol", "date", change("close", n).alias("m")).filter("m IS NOT NULL")
    per = mom.join(constituents, "symbol").groupBy("date", "sector").agg(F.avg("m").alias("momentum"))
    return per.groupBy("date").agg(F.max_by("sector", F.struct("momentum", "sector")).alias("top_sector"),
                                   F.max("momentum").alias("momentum"))


# -- factors ----------------------------------------------------------------------------------------
def capm(returns: DataFrame, market: DataFrame) -> DataFrame:
    both = returns.join(market, "date").filter("ret_1d IS NOT NULL AND mkt IS NOT NULL")
    return both.groupBy("symbol").agg(
        F.count("*").alias("n"), F.regr_intercept("ret_1d", "mkt").alias("alpha"),
        F.regr_slope("ret_1d", "mkt").alias("beta"), F.regr_r2("ret_1d", "mkt").alias("r2"))


def factor_ols(returns: DataFrame, factors: DataFrame) -> DataFrame:
    """Three-factor regression per symbol: covariances in one pass, the 3x3 system in columns."""
    x = ("mkt", "smb", "hml")
    both = returns.join(factors, "date").dropna(subset=["ret_1d", *x])
    aggs = [F.covar_samp(a, b).alias(f"{a}_{b}") for i, a in enumerate(x) for b in x[i:]]
    aggs += [F.covar_samp("ret_1d", a).alias(f"y_{a}") for a in x]
    aggs += [F.avg(a).alias(f"m_{a}") for a in (*x, "ret_1d")]
    df = both.groupBy("symbol").agg(F.count("*").alias("n"), *aggs)

    def cov(i: int, j: int) -> Column:
        a, b = sorted((i, j))
        return F.col(f"{x[a]}_{x[b]}")

    def det(m) -> Column:
        return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
                - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))
    full = [[cov(i, j) for j in range(3)] for i in range(3)]
    whole = det(full)
    for k, name in enumerate(x):
        swapped = [[F.col(f"y_{x[i]}") if j == k else full[i][j] for j in range(3)] for i in range(3)]
        df = df.withColumn(f"beta_{name}", safe_div(det(swapped), whole))
    alpha = F.col("m_ret_1d")
    for name in x:
        alpha = alpha - F.col(f"beta_{name}") * F.col(f"m_{name}")
    return df.withColumn("alpha", alpha).select("symbol", "n", "alpha", *[f"beta_{a}" for a in x])


def bayes_beta(returns: DataFrame, factor: DataFrame, prior_mean: float = -0.001, prior_var: float = 0.01
               ) -> DataFrame:
    """Least-squares beta shrunk to a normal prior."""
    both = returns.join(factor, "date").filter("ret_1d IS NOT NULL AND mkt IS NOT NULL")
    df = both.groupBy("symbol").agg(
        F.count("*").alias("n"), F.covar_samp("ret_1d", "mkt").alias("c"), F.var_pop("mkt").alias("vx"),
        F.covar_pop("ret_1d", "mkt").alias("cp"), F.var_pop("ret_1d").alias("vy"))
    beta = safe_div("c", "vx")
    df = df.withColumn("ols_beta", beta)
    resid = F.col("vy") - 2 * F.col("ols_beta") * F.col("cp") + F.col("ols_beta") * F.col("ols_beta") * F.col("vx")
    df = df.withColumn("ols_var", resid / (F.col("vx") * F.col("n")))
    post_var = F.lit(1.0) / (F.lit(1 / prior_var) + F.lit(1.0) / F.col("ols_var"))
    return df.withColumn("confidence", F.lit(1.0) / post_var).withColumn(
        "posterior_beta", post_var * (F.lit(prior_mean / prior_var) + F.col("ols_beta") / F.col("ols_var"))
    ).select("symbol", "n", "ols_beta", "posterior_beta", "confidence")


def pca_factors(wide: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """Explained variance and loadings of a narrow returns table (one column per sector)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(wide.dropna())
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    rows = [(f"PC{j + 1}", c, float(model.explainedVariance[j]), float(model.pc.toArray()[i, j]))
            for j in range(k) for i, c in enumerate(columns)]
    return wide.sparkSession.createDataFrame(
        rows, "component string, name string, explained double, loading double")


def best_anchor(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best strategy per key, kept only where it beats the null."""
    top = sweep.groupBy(*keys).agg(F.max_by(
        F.struct("strategy", "sharpe", "sharpe_over_null"),
        F.struct("sharpe_over_null", "strategy")).alias("r"))
    return top.select(*keys, "r.*").filter(F.col("sharpe_over_null") > 0)


def require_anchor(wanted: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Anchors of the wanted keys; a key without an earned anchor fails the job."""
    joined = wanted.join(anchors, key, "left")
    return joined.withColumn("strategy", F.when(F.col("strategy").isNull(), F.raise_error(
        F.concat(F.lit("not calibrated: "), F.col(key)))).otherwise(F.col("strategy")))
