"""Technical indicators over the long bar table, one hash partitioning by symbol for all."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import (
    avg_full, bands, clamp, lagged, running, safe_div, stddev_full, trailing, with_moving_z, yes,
)
from bourselake.operators.recurrence import ema, wilder

YEAR = 252


def sma(c, n: int) -> Column:
    return avg_full(c, n)


def change(c, n: int = 1) -> Column:
    """Relative change against the value n bars back."""
    c = F.col(c) if isinstance(c, str) else c
    return safe_div(c, lagged(c, n)) - 1


def bar_number() -> Column:
    return F.row_number().over(Window.partitionBy("symbol").orderBy("date"))


def true_range() -> Column:
    prev = lagged("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                      F.abs(F.col("low") - prev))


def with_rsi(df: DataFrame, period: int = 14, out: str = "rsi") -> DataFrame:
    """Strength index on Wilder means; a series without losses reads 100."""
    df = df.withColumn("_d", F.col("close") - lagged("close"))
    df = df.withColumn("_up", F.greatest("_d", F.lit(0.0))).withColumn(
        "_down", F.greatest(-F.col("_d"), F.lit(0.0)))
    head = F.col("_d").isNotNull()
    df = df.withColumn("_up", F.when(head, F.col("_up"))).withColumn(
        "_down", F.when(head, F.col("_down")))
    df = wilder(df, {"_gain": "_up", "_loss": "_down"}, period)
    share = safe_div("_gain", F.col("_gain") + F.col("_loss"))
    return df.withColumn(out, share * F.lit(100.0)).drop("_d", "_up", "_down", "_gain", "_loss")


def with_rsi_simple(df: DataFrame, period: int = 14, out: str = "rsi_sma") -> DataFrame:
    """Variant on plain rolling means of the daily return."""
    df = df.withColumn("_r", change("close"))
    gain = F.when(F.col("_r") > 0, F.col("_r")).otherwise(F.lit(0.0))
    loss = F.when(F.col("_r") < 0, -F.col("_r")).otherwise(F.lit(0.0))
    ratio = avg_full(gain, period) / (avg_full(loss, period) + F.lit(1e-10))
    return df.withColumn(out, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio)).drop("_r")


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(ema(df, "close", fast, "_fast"), "close", slow, "_slow")
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = ema(df, "macd", signal, "macd_signal")
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def with_atr(df: DataFrame, period: int = 14, out: str = "atr") -> DataFrame:
    return wilder(df.withColumn("_tr", true_range()), {out: "_tr"}, period).drop("_tr")


def with_bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    width = F.lit(k) * stddev_full("close", n)
    return (df.withColumn("bb_mid", sma("close", n))
            .withColumn("bb_upper", F.col("bb_mid") + width)
            .withColumn("bb_lower", F.col("bb_mid") - width))


def with_adx(df: DataFrame, period: int = 14, out: str = "adx") -> DataFrame:
    """Directional movement; its two recurrences have no minimum length."""
    up, down = F.col("high") - lagged("high"), lagged("low") - F.col("low")
    df = df.withColumn("_u", up).withColumn("_w", down).withColumn("_tr", true_range())
    first = F.col("_u").isNotNull()
    df = df.withColumn("_pdm", F.when(first, F.when(
        (F.col("_u") > F.col("_w")) & (F.col("_u") > 0), F.col("_u")).otherwise(F.lit(0.0))))
    df = df.withColumn("_mdm", F.when(first, F.when(
        (F.col("_w") > F.col("_u")) & (F.col("_w") > 0), F.col("_w")).otherwise(F.lit(0.0))))
    df = wilder(df, {"_atr": "_tr"}, period)
    df = wilder(df, {"_ps": "_pdm", "_ms": "_mdm"}, period, min_periods=1)
    plus, minus = safe_div("_ps", "_atr"), safe_div("_ms", "_atr")
    df = df.withColumn("_dx", F.lit(100.0) * safe_div(F.abs(plus - minus), plus + minus))
    return wilder(df, {out: "_dx"}, period).drop(
        "_u", "_w", "_tr", "_pdm", "_mdm", "_atr", "_ps", "_ms", "_dx")


def indicator_panel(df: DataFrame) -> DataFrame:
    df = df.withColumn("sma_20", sma("close", 20)).withColumn("sma_50", sma("close", 50))
    df = with_bollinger(df.withColumn("sma_200", sma("close", 200)))
    df = ema(df, "close", 20, "ema_20")
    return with_adx(with_atr(with_macd(with_rsi(df, out="rsi_14")), out="atr_14"), out="adx_14")


SNAPSHOT = ("close", "sma_20", "sma_50", "sma_200", "ema_20", "rsi_14", "macd", "macd_signal",
            "macd_hist", "bb_upper", "bb_mid", "bb_lower", "atr_14", "adx_14")


def indicator_snapshot(df: DataFrame) -> DataFrame:
    """Latest valid bar per symbol with every indicator and the golden-cross flag."""
    panel = indicator_panel(df.filter("close IS NOT NULL"))
    latest = panel.groupBy("symbol").agg(
        F.max("date").alias("date"),
        F.max_by(F.struct(*SNAPSHOT), "date").alias("s"))
    return latest.select("symbol", "date", "s.*").withColumn(
        "golden_cross", F.col("sma_50") > F.col("sma_200"))


# -- the feature panel of the candidate scan ---------------------------------------------------
Z_METRICS = ("ret_1d", "rel_volume", "gap", "atr_pct")


def close_position() -> Column:
    """Close within the day's range, null on an empty range."""
    return clamp(safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")))


def rolling_z(c: str, n: int = 60, at_least: int = 30, population: bool = True) -> Column:
    return safe_div(F.col(c) - avg_full(c, n, at_least), stddev_full(c, n, at_least, population))


def feature_panel(bars: DataFrame) -> DataFrame:
    """Every per-symbol feature for every date."""
    prev20 = Window.partitionBy("symbol").orderBy("date").rowsBetween(-20, -1)
    full_prev = F.count("high").over(prev20) == 20
    df = (bars.withColumn("prev_close", lagged("close"))
          .withColumn("ret_1d", safe_div("close", "prev_close") - 1)
          .withColumn("ma20", sma("close", 20)).withColumn("ma50", sma("close", 50))
          .withColumn("ma200", sma("close", 200))
          .withColumn("vol_avg20", avg_full("volume", 20))
          .withColumn("rel_volume", safe_div("volume", "vol_avg20"))
          .withColumn("high20_prev", F.when(full_prev, F.max("high").over(prev20)))
          .withColumn("low20_prev", F.when(full_prev, F.min("low").over(prev20)))
          .withColumn("close_pos", close_position())
          .withColumn("gap", safe_div("open", "prev_close") - 1)
          .withColumn("rs_120", change("close", 120))
          .withColumn("tr", true_range())
          .withColumn("atr14", avg_full("tr", 14))
          .withColumn("atr_pct", safe_div("atr14", "close")))
    for metric in Z_METRICS:
        df = with_moving_z(df, metric, f"{metric}_z", 60, 30, population=True)
    return df


def average_rank_pct(c: str, part: str = "date") -> Column:
    """Percentile by average rank of ties over the non-null values of a cross-section."""
    value = F.col(c)
    group = Window.partitionBy(part, value.isNull())
    rank = F.rank().over(group.orderBy(value))
    ties = F.count(value).over(Window.partitionBy(part, value.isNull(), value))
    return F.when(value.isNotNull(),
                  (rank + (ties - 1) / F.lit(2.0)) / F.count(value).over(group))


# -- deviation and range -----------------------------------------------------------------------
def deviation_z(ma: int = 25, window: int = 120, trend: int = 200):
    """(df) -> df with dev_z: the deviation from the mean, scored on its own recent history."""
    def add(df: DataFrame) -> DataFrame:
        df = df.withColumn("_dev", safe_div(F.col("close") - sma("close", ma), sma("close", ma)))
        df = with_moving_z(df, "_dev", "_z", window, window, population=False)
        return df.withColumn("dev_z", F.when(bar_number() >= max(ma, trend), F.col("_z"))).drop("_dev", "_z")
    return add


def window_z(n: int = 25) -> Column:
    return safe_div(F.col("close") - sma("close", n), stddev_full("close", n))


def drawdown(c: str = "close") -> Column:
    return safe_div(F.col(c), F.max(c).over(running())) - 1


def at_extreme(n: int = YEAR, at_least: int = 20) -> tuple[Column, Column]:
    w = trailing(n)
    enough = F.count("close").over(w) >= at_least
    return (yes(enough & (F.col("close") >= F.max("close").over(w))),
            yes(enough & (F.col("close") <= F.min("close").over(w))))


def rolling_median(c: str, n: int) -> Column:
    """Exact median of the last n rows, nulls left out (frames are at most n values)."""
    values = F.array_sort(F.collect_list(c).over(trailing(n)))
    size = F.size(values)
    low = F.try_element_at(values, F.floor((size + 1) / 2).cast("int"))
    high = F.try_element_at(values, (F.floor(size / 2) + 1).cast("int"))
    return F.when(size > 0, (low + high) / 2)


def with_absorption(df: DataFrame, window: int = 20) -> DataFrame:
    """Is the sell-off bar being absorbed: volume, close in range and delivery, each 0..1."""
    df = (df.withColumn("_vm", rolling_median("volume", window))
          .withColumn("_dl", F.last("delivery_pct", ignorenulls=True).over(running()))
          .withColumn("_dm", rolling_median("delivery_pct", window))
          .withColumn("_dn", F.count("delivery_pct").over(running()))
          .withColumn("_rn", bar_number()))
    vol = F.when(F.col("_vm") > 0, clamp((F.col("volume") / F.col("_vm") - 1) / 2)).otherwise(0.0)
    rng = F.when(F.col("high") > F.col("low"), clamp(close_position())).otherwise(0.5)
    deliv = (F.when(F.col("_dn") < 2, 0.5)
             .when(F.col("_dm") > 0, clamp((F.col("_dl") / F.col("_dm") - 1) / 0.5))
             .otherwise(0.0))
    score = (vol + rng + deliv) / 3
    return df.withColumn("absorption", F.when(
        (F.col("_rn") >= window + 1) & (F.col("volume") > 0), score)).drop(
        "_vm", "_dl", "_dm", "_dn", "_rn")


def with_trend_band(df: DataFrame, zone: float = 0.03) -> DataFrame:
    df = df.withColumn("_ma", sma("close", 200))
    df = df.withColumn("ma_gap", safe_div("close", "_ma") - 1).withColumn(
        "ma_slope", F.coalesce(safe_div("_ma", lagged("_ma", 20)) - 1, F.lit(0.0)))
    label = (F.when(F.col("ma_gap").isNull(), "n/a")
             .when(F.abs("ma_gap") <= zone, F.when(F.col("ma_slope") > 0, "decision zone, rising")
                   .otherwise("decision zone, falling"))
             .when(F.col("ma_gap") > 0, "uptrend").otherwise("downtrend"))
    return df.withColumn("trend", label).drop("_ma")


# -- screen inputs -------------------------------------------------------------------------------
def nested_range(windows=(120, 60, 30, 15)) -> list[Column]:
    """High, low and depth over nested trailing windows, longest first."""
    out = []
    for n in windows:
        high, low = F.max("high").over(trailing(n)), F.min("low").over(trailing(n))
        out += [high.alias(f"high_{n}"), low.alias(f"low_{n}"),
                ((high - low) / high * 100).alias(f"depth_{n}")]
    return out


def volume_dryup(short: int = 10, long: int = 50) -> Column:
    return safe_div(avg_full("volume", short), avg_full("volume", long))


DRY_UP_STEPS = ((0.9, 15.0), (0.8, 30.0), (0.7, 45.0), (0.6, 60.0), (0.5, 70.0), (0.4, 80.0))
RS_STEPS = ((50.0, 95.0), (30.0, 80.0), (15.0, 65.0), (5.0, 50.0), (0.0, 35.0))
RS_PERIODS = ((63, 0.40), (126, 0.20), (189, 0.20), (252, 0.20))


def weighted_excess(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Weighted excess return in percent over four look-backs; short histories use what exists.

    The benchmark takes its own row positions: the look-back is min(period, its history) rows.
    """
    first = F.first("close").over(running())
    df = df.withColumn("_n", bar_number())
    single = F.lit("index")
    bench = benchmark.select("date", F.col("close").alias("_b"), single.alias("_k"))
    bench = bench.withColumn("_bn", F.row_number().over(Window.partitionBy("_k").orderBy("date")))
    b_first = F.first("_b").over(running("_k"))
    names = []
    for n, _ in RS_PERIODS:
        df = df.withColumn(f"_s{n}", (safe_div("close", F.coalesce(lagged("close", n), first)) - 1)
                           * 100)
        past = F.coalesce(F.lag("_b", n).over(Window.partitionBy("_k").orderBy("date")), b_first)
        bench = bench.withColumn(f"_b{n}", (safe_div("_b", past) - 1) * 100)
        names.append(f"_b{n}")
    joined = df.join(bench.select("date", *names), "date", "left")
    total = F.lit(0.0)
    for n, weight in RS_PERIODS:
        total = total + F.lit(weight) * (F.col(f"_s{n}") - F.coalesce(f"_b{n}", F.lit(0.0)))
    return joined.withColumn("rs_value", total).drop(
        "_n", *names, *[f"_s{n}" for n, _ in RS_PERIODS])


def with_trend_template(df: DataFrame) -> DataFrame:
    """Seven moving-average conditions and the stage they suggest."""
    df = (df.withColumn("_50", sma("close", 50)).withColumn("_150", sma("close", 150))
          .withColumn("_200", sma("close", 200)))
    df = df.withColumn("_200m", lagged("_200", 21))
    close = F.col("close")
    tests = (close > F.col("_150"), close > F.col("_200"), F.col("_150") > F.col("_200"),
             F.col("_200") > F.col("_200m"), F.col("_50") > F.col("_150"),
             F.col("_50") > F.col("_200"), close > F.col("_50"))
    met = sum((yes(t).cast("int") for t in tests), F.lit(0))
    stage = (F.when(F.col("_met") >= 6, 2)
             .when((close < F.col("_200")) & (F.col("_50") < F.col("_200")), 4)
             .when((close > F.col("_200")) & (F.col("_50") < F.col("_150")), 1).otherwise(3))
    ready = F.col("_200").isNotNull()
    df = df.withColumn("_met", met)
    return (df.withColumn("criteria_met", F.when(ready, F.col("_met")).otherwise(0))
            .withColumn("trend_score", F.col("criteria_met") * F.lit(100 / 7))
            .withColumn("stage", F.when(ready, stage).otherwise(0))
            .drop("_50", "_150", "_200", "_200m", "_met"))


def with_hist_vol(df: DataFrame, n: int = 30, fallback: float = 0.15) -> DataFrame:
    df = df.withColumn("_lr", F.ln(safe_div("close", lagged("close"))))
    w = trailing(n)
    return df.withColumn("hist_vol", F.when(
        F.count("_lr").over(w) >= 2, F.stddev_samp("_lr").over(w) * F.lit(math.sqrt(YEAR)))
        .otherwise(F.lit(fallback))).drop("_lr")


def technical_features(bars: DataFrame) -> DataFrame:
    """Multi-horizon returns, positions against means, volatility, strength and volume flags."""
    year = F.lit(math.sqrt(YEAR))
    df = bars.withColumn("ret_1d", change("close"))
    for n in (5, 20, 60):
        df = df.withColumn(f"ret_{n}d", change("close", n))
    for n in (20, 50, 200):
        df = df.withColumn(f"price_vs_ma{n}", safe_div("close", sma("close", n)) - 1)
    df = df.withColumn("golden_cross", yes(sma("close", 50) > sma("close", 200)).cast("bigint"))
    for n in (10, 30):
        df = df.withColumn(f"vol_{n}d", stddev_full("ret_1d", n) * year)
    df = df.withColumn("vol_ratio", F.col("vol_10d") / (F.col("vol_30d") + F.lit(1e-10)))
    df = with_rsi_simple(df)
    df = df.withColumn("bb_position", (F.col("close") - sma("close", 20)) / (
        F.lit(2.0) * stddev_full("close", 20) + F.lit(1e-10)))
    df = df.withColumn("drawdown", drawdown())
    mean = avg_full("volume", 20)
    return (df.withColumn("vol_ratio_price", F.col("volume") / (mean + 1))
            .withColumn("vol_spike", yes(F.col("volume") > mean * 2).cast("bigint")))


def ffill_asof(left: DataFrame, right: DataFrame, value: str, out: str) -> DataFrame:
    """Latest `right` value at or before each `left` date, for a right side of one row per date.

    The two date lists are merged and the value is carried forward over the calendar, which has
    one row per date whatever the size of `left`; the result joins back on equality.
    """
    dates = left.select("date").distinct()
    calendar = dates.join(right.select("date", F.col(value).alias("_v")), "date", "full_outer")
    filled = calendar.select("date", F.last("_v", ignorenulls=True).over(running([], "date"))
                             .alias(out))
    return left.join(filled, "date", "left")


def sliding_rank(df: DataFrame, value: str, window: int, out: str, bins: int = 16) -> DataFrame:
    """Rank of a value among the last `window` rows of its symbol, over their number; ties share the middle of their range.

    Null until the window is full of values. A symbol's values are cut into bins of about equal size. Rows in lower bins are
    differences of running counts, constant work per row; only rows of the same bin are compared one by one.
    """
    whole = Window.partitionBy("symbol")
    until = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    gone = whole.orderBy("date").rowsBetween(Window.unboundedPreceding, -window)

    def recent(what: Column) -> Column:
        return F.count(what).over(until) - F.count(what).over(gone)

    edges = F.percentile_approx(value, [i / bins for i in range(1, bins)], 1000).over(whole)
    df = df.withColumn("_edges", edges).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    df = df.withColumn("_row", F.row_number().over(whole.orderBy("date"))).withColumn("_full", recent(F.col(value)))
    df = df.select("*", *[recent(F.when((F.col("_bin") == b) & F.col(value).isNotNull(), 1)).alias(f"_in{b}") for b in range(bins - 1)])
    lower = sum((F.when(F.col("_bin") > b, F.col(f"_in{b}")).otherwise(0) for b in range(bins - 1)), F.lit(0))
    df = df.withColumn("_lower", lower).drop(*[f"_in{b}" for b in range(bins - 1)])
    near = Window.partitionBy("symbol", "_bin").orderBy("_row").rangeBetween(-(window - 1), 0)
    df = df.withColumn("_near", F.collect_list(value).over(near))
    below = F.size(F.filter("_near", lambda v: v < F.col(value)))
    upto = F.size(F.filter("_near", lambda v: v <= F.col(value)))
    rank = (2 * F.col("_lower") + below + upto + 1) / F.lit(2.0) / window
    return df.withColumn(out, F.when(F.col("_full") == window, rank)).drop("_bin", "_row", "_full", "_lower", "_near")


def with_ewma_vol(df: DataFrame, decay: float = 0.94, window: int = YEAR) -> DataFrame:
    """Conditional volatility of percent returns, its percentile in a year and the surprise."""
    from bourselake.operators.recurrence import ewm
    df = df.withColumn("_r", change("close") * 100).withColumn("_r2", F.col("_r") * F.col("_r"))
    df = ewm(df, {"_var": "_r2"}, 1 - decay).withColumn("cond_vol", F.sqrt("_var"))
    df = sliding_rank(df, "cond_vol", window, "vol_percentile")
    return (df.withColumn("vol_surprise", F.abs("_r") - F.col("cond_vol"))
            .drop("_r", "_r2", "_var"))


def dry_up_score(ratio) -> Column:
    return bands(ratio, DRY_UP_STEPS, 90.0)


def rs_score(value) -> Column:
    return bands(value, RS_STEPS, 15.0, strict=True)
