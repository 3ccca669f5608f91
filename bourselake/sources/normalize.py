"""Turning delivered price rows into the long bar table."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import lagged, safe_div

CORE = ("open", "high", "low", "close", "volume")
EXTRAS = ("delivery_pct", "deliverable_qty", "vwap", "trades")


def require(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def scan_bars(df: DataFrame) -> DataFrame:
    """Lower-case names, required columns present, upper-case symbol, incomplete rows dropped."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    require(df, ("symbol", "timestamp", *CORE))
    df = df.select(F.upper(F.col("symbol").cast("string")).alias("symbol"),
                   F.to_date("timestamp").alias("date"), *CORE)
    return df.dropna()


def normalize_bars(df: DataFrame, sequence: list[str], date_format: str = "yyyy-MM-dd"
                   ) -> DataFrame:
    """Parse dates, drop bad ones, keep the last delivery per symbol and date, order columns.

    The last delivery is a mergeable maximum, so repeated copies of one key are folded on the
    map side and never meet in one task.
    """
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    require(df, ("symbol", "date", "close", *sequence))
    kept = [c for c in (*CORE, *EXTRAS) if c in df.columns]
    df = df.withColumn("date", F.try_to_date(F.col("date").cast("string"), date_format))
    last = F.max(F.struct(*sequence, *kept)).alias("r")
    return (df.filter("date IS NOT NULL AND symbol IS NOT NULL").groupBy("symbol", "date")
            .agg(last).select("symbol", "date", *[f"r.{c}" for c in kept]))


def split_gaps(bars: DataFrame, min_drop: float = 1.4, tolerance: float = 0.06) -> DataFrame:
    """One-day drops close to an integer ratio from 2 to 20."""
    ratio = safe_div(lagged("close"), "close")
    df = bars.select("symbol", "date", ratio.alias("raw_ratio")).filter(
        F.col("raw_ratio") > min_drop)
    df = df.withColumn("ratio", F.floor(F.col("raw_ratio") + F.lit(0.5)).cast("bigint"))
    close_enough = F.abs(F.col("raw_ratio") - F.col("ratio")) / F.col("ratio") < tolerance
    return df.filter(F.col("ratio").between(2, 20) & close_enough)


def split_adjust(bars: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Divide prices before each ex-date by the later ratios, multiply quantities.

    `confirmed(symbol, ratio)` restricts the gaps of every symbol it mentions.
    """
    gaps = split_gaps(bars).select("symbol", "date", "ratio")
    if confirmed is not None:
        known = confirmed.select("symbol", F.lit(True).alias("_known")).distinct()
        pairs = confirmed.select("symbol", F.col("ratio").cast("bigint").alias("ratio"),
                                 F.lit(True).alias("_pair")).distinct()
        gaps = (gaps.join(known, "symbol", "left").join(pairs, ["symbol", "ratio"], "left")
                .filter("_known IS NULL OR _pair").select("symbol", "date", "ratio"))
    later = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    df = bars.join(gaps, ["symbol", "date"], "left")
    log_sum = F.coalesce(F.sum(F.ln(F.col("ratio").cast("double"))).over(later), F.lit(0.0))
    df = df.withColumn("factor", F.floor(F.exp(log_sum) + F.lit(0.5)).cast("double")).drop("ratio")
    for name in ("open", "high", "low", "close", "vwap"):
        if name in df.columns:
            df = df.withColumn(name, F.col(name) / F.col("factor"))
    for name in ("volume", "deliverable_qty"):
        if name in df.columns:
            df = df.withColumn(name, F.col(name) * F.col("factor"))
    return df


def layered(layers: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Best layer per key, first in the list wins; all rows of that layer are kept."""
    stacked = None
    for rank, (name, df) in enumerate(layers):
        part = df.withColumn("source_layer", F.lit(name)).withColumn("_rank", F.lit(rank))
        stacked = part if stacked is None else stacked.unionByName(part)
    best = stacked.groupBy(key).agg(F.min("_rank").alias("_rank"))
    return stacked.join(best, [key, "_rank"]).drop("_rank")


def members_of(membership: DataFrame, name: str) -> DataFrame:
    """Members of one index; an unknown name fails."""
    found = membership.filter(F.col("sector") == name)
    if found.isEmpty():
        raise KeyError(f"unknown index {name}")
    return found


def freshness(df: DataFrame, as_of: str, limit_days: int = 5) -> DataFrame:
    """Latest date, its age and whether it is fresh at `as_of`."""
    latest = df.agg(F.max("date").alias("latest_date"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest_date"))
    return latest.select(
        "latest_date", age.cast("bigint").alias("days_old"), (age <= limit_days).alias("is_fresh"),
        F.when(age > limit_days, F.concat(F.lit("data is "), age.cast("string"),
                                          F.lit(" days old"))).otherwise("").alias("warning"))


def with_provenance(df: DataFrame, tag: str) -> DataFrame:
    if tag not in ("computed", "sourced"):
        raise ValueError(tag)
    return df.withColumn("provenance", F.lit(tag))


def resample_monthly(bars: DataFrame) -> DataFrame:
    """Calendar-month bars: first open, extreme prices, last close, summed volume."""
    return bars.groupBy("symbol", F.trunc("date", "MM").alias("month")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"), F.max("date").alias("last_date"))


def upsert_history(history: DataFrame, new: DataFrame, key: str = "data_date",
                   keep: int = 20) -> DataFrame:
    """New rows replace old ones with the same key; the latest `keep` keys remain."""
    columns = [c for c in history.columns if c != key]
    both = history.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    merged = both.groupBy(key).agg(F.max_by(F.struct(*columns), "_new").alias("r"))
    return merged.select(key, "r.*").orderBy(F.desc(key)).limit(keep)
