"""Signal outcomes and the feedback drawn from them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import clamp

# Outcome thresholds on the primary return.
FLAT, SEVERE = 0.005, 0.02
GRACE_DAYS = 5


def price_on_or_after(bars: DataFrame, days: int = GRACE_DAYS) -> DataFrame:
    """(symbol, target_date) -> first price within `days` days at or after the date.

    Every bar states the dates it answers for (at most `days` of them), so the as-of join becomes
    an equality join on a unique key, whatever the number of signals per symbol.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    first = F.date_sub("date", days - 1)
    after_prev = F.date_add(F.lag("date").over(w), 1)
    df = bars.select("symbol", "date", "close", F.greatest(first, after_prev).alias("from"))
    return df.select("symbol", F.explode(F.sequence("from", "date")).alias("target_date"),
                     F.col("close").alias("price"), F.col("date").alias("price_date"))


def forward_returns(signals: DataFrame, bars: DataFrame, periods: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Entry at the signal date, realised return per period, exit price and date with defaults."""
    entry = bars.select(F.col("symbol").alias("ticker"), F.col("date").alias("signal_date"),
                        F.col("close").alias("entry_price"))
    df = signals.join(entry, ["ticker", "signal_date"])
    lookup = price_on_or_after(bars).withColumnRenamed("symbol", "ticker")
    for p in periods:
        side = lookup.select("ticker", F.date_sub("target_date", p).alias("signal_date"),
                             F.col("price").alias(f"price_{p}"), F.col("price_date").alias(f"date_{p}"))
        df = df.join(side, ["ticker", "signal_date"], "left").withColumn(
            f"ret_{p}d", F.col(f"price_{p}") / F.col("entry_price") - 1)
    return (df.withColumn("exit_price", F.coalesce(*[f"price_{p}" for p in periods], "entry_price"))
            .withColumn("exit_date", F.coalesce(*[f"date_{p}" for p in periods],
                                                F.date_add("signal_date", periods[0])))
            .withColumn("holding_days", F.datediff("exit_date", "signal_date"))
            .drop(*[f"price_{p}" for p in periods], *[f"date_{p}" for p in periods]))


def outcome(direction: str, ret, at_signal: str, at_exit: str) -> Column:
    d = F.col(direction)
    r = F.coalesce(F.col(ret) if isinstance(ret, str) else ret, F.lit(0.0))
    changed = (F.col(at_signal) != F.col(at_exit)) & (F.col(at_exit) != "UNKNOWN")
    against = ((d == "LONG") & (r < -SEVERE)) | ((d == "SHORT") & (r > SEVERE))
    hit = ((d == "LONG") & (r > 0)) | ((d == "SHORT") & (r < 0))
    return (F.when(changed & against, "REGIME_MISMATCH").when(F.abs(r) < FLAT, "NEUTRAL")
            .when(hit, "TRUE_POSITIVE").when(F.abs(r) > SEVERE, "FALSE_POSITIVE_SEVERE")
            .otherwise("FALSE_POSITIVE"))


def ready(signals: DataFrame, as_of: str, min_days: int = 5) -> DataFrame:
    return signals.filter(F.datediff(F.lit(as_of).cast("date"), F.col("signal_date")) >= min_days)


def _counts() -> list[Column]:
    o = F.col("outcome")
    return [F.count("*").alias("sample_size"), F.count_if(o == "TRUE_POSITIVE").alias("true_positive"),
            F.count_if(o.startswith("FALSE_POSITIVE")).alias("false_positive"),
            F.count_if(o == "FALSE_POSITIVE_SEVERE").alias("false_positive_severe"),
            F.count_if(o == "REGIME_MISMATCH").alias("regime_mismatch"),
            F.count_if(o == "NEUTRAL").alias("neutral"),
            F.avg(F.coalesce("ret_5d", F.lit(0.0))).alias("avg_return_5d")]


def _with_rates(df: DataFrame) -> DataFrame:
    decided = F.col("true_positive") + F.col("false_positive")
    return df.withColumn("accuracy", F.coalesce(F.try_divide("true_positive", decided), F.lit(0.0))).withColumn(
        "false_positive_rate", F.try_divide("false_positive", "sample_size"))


def skill_metrics(postmortems: DataFrame) -> DataFrame:
    return _with_rates(postmortems.groupBy("skill").agg(*_counts()))


def postmortem_cube(postmortems: DataFrame) -> DataFrame:
    """Breakdown by skill, by month and overall in one pass."""
    df = postmortems.withColumn("month", F.date_format("signal_date", "yyyy-MM"))
    cube = df.groupingSets([["skill"], ["month"], []], "skill", "month").agg(*_counts())
    return _with_rates(cube)


def outcome_share(postmortems: DataFrame) -> DataFrame:
    counted = postmortems.groupBy("outcome").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def worst_regime(postmortems: DataFrame, least: int = 5, above: float = 0.2) -> DataFrame:
    """Regime with the highest false-positive rate per skill, NONE where no regime qualifies."""
    rates = postmortems.groupBy("skill", "regime_at_signal").agg(
        F.count("*").alias("n"),
        F.avg(F.col("outcome").startswith("FALSE_POSITIVE").cast("int")).alias("rate"))
    bad = rates.filter((F.col("n") >= least) & (F.col("rate") > above)).groupBy("skill").agg(
        F.max_by("regime_at_signal", F.struct("rate", "regime_at_signal")).alias("worst"),
        F.max("rate").alias("worst_rate"))
    return postmortems.select("skill").distinct().join(bad, "skill", "left").select(
        "skill", F.coalesce("worst", F.lit("NONE")).alias("worst_regime"), "worst_rate")


def weight_feedback(metrics: DataFrame, min_sample: int = 20, baseline: float = 0.55,
                    sensitivity: float = 0.5) -> DataFrame:
    """Suggested weight per skill where the change is meaningful."""
    weight = clamp(F.lit(1.0) + (F.col("accuracy") - baseline) * sensitivity, 0.3, 2.0)
    df = metrics.filter(F.col("sample_size") >= min_sample).withColumn("suggested_weight", weight)
    reason = F.concat_ws("; ", F.when(F.col("false_positive_rate") > 0.15, "false positive rate"),
                         F.when(F.col("accuracy") < baseline, "below baseline accuracy"),
                         F.when(F.col("accuracy") > 0.65, "strong accuracy"))
    return df.filter(F.abs(F.lit(1.0) - F.col("suggested_weight")) >= 0.05).withColumn(
        "reason", F.when(reason == "", "accuracy-based adjustment").otherwise(reason))


def improvement_backlog(metrics: DataFrame, worst: DataFrame, min_sample: int = 15) -> DataFrame:
    """Issues per skill: false-positive cluster, regime sensitivity, overconfidence."""
    df = metrics.filter(F.col("sample_size") >= min_sample).join(worst, "skill")
    mismatch = F.try_divide("regime_mismatch", "sample_size")
    severe = F.try_divide("false_positive_severe", "sample_size")

    def issue(kind: str, cond: Column, severity: Column, rate: Column, scale: int) -> DataFrame:
        return df.filter(cond).select(
            "skill", F.lit(kind).alias("issue_type"), severity.alias("severity"), rate.alias("rate"),
            "worst_regime", F.floor(rate * F.col("sample_size") * scale + 1e-6).alias("priority_score"))
    fp = F.col("false_positive_rate")
    return (issue("false_positive_cluster", fp > 0.15, F.when(fp > 0.25, "high").otherwise("medium"), fp, 100)
            .unionByName(issue("regime_sensitivity", mismatch > 0.25, F.lit("medium"), mismatch, 80))
            .unionByName(issue("overconfidence", severe > 0.10, F.lit("high"), severe, 150))
            .orderBy(F.desc("priority_score"), "skill"))
