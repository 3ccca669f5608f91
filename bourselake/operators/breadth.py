"""Market breadth: per-symbol windows folded to one row per date."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.functions import lagged, running, yes
from bourselake.operators.indicators import at_extreme, sma

WARM_UP_DAYS = 420


def warm_slice(bars: DataFrame, start: str, end: str, days: int = WARM_UP_DAYS) -> DataFrame:
    """Date filter below the windows, so that it reaches the scan of a stored bar table."""
    first = F.date_sub(F.lit(start).cast("date"), days)
    return bars.filter((F.col("date") >= first) & (F.col("date") <= F.lit(end).cast("date")))


def trim(df: DataFrame, start: str) -> DataFrame:
    return df.filter(F.col("date") >= F.lit(start).cast("date"))


def _flags(bars: DataFrame) -> DataFrame:
    prev = lagged("close")
    high, low = at_extreme()
    return (bars.withColumn("_a50", yes(F.col("close") > sma("close", 50)))
            .withColumn("_a200", yes(F.col("close") > sma("close", 200)))
            .withColumn("_adv", yes(F.col("close") > prev))
            .withColumn("_dec", yes(F.col("close") < prev))
            .withColumn("_hi", high).withColumn("_lo", low))


def _fold(flags: DataFrame, keys: list[str]) -> DataFrame:
    daily = flags.groupBy(*keys, "date").agg(
        F.count("close").alias("n"), F.count_if("_a50").alias("_a50"),
        F.count_if("_a200").alias("_a200"), F.count_if("_adv").alias("advancers"),
        F.count_if("_dec").alias("decliners"), F.count_if("_hi").alias("new_highs"),
        F.count_if("_lo").alias("new_lows"))
    # one row per key and calendar date from here on
    return (daily.withColumn("pct_above_50", F.try_divide("_a50", "n"))
            .withColumn("pct_above_200", F.try_divide("_a200", "n"))
            .withColumn("ad_line", F.sum(F.col("advancers") - F.col("decliners"))
                        .over(running(keys, "date")))
            .drop("_a50", "_a200"))


def breadth_series(bars: DataFrame) -> DataFrame:
    """Share above two means, advance/decline and its line, yearly extremes, names present."""
    return _fold(_flags(bars), [])


def sector_breadth(bars: DataFrame, constituents: DataFrame, market: str = "MARKET") -> DataFrame:
    """The same per sector, plus the union of all members counted once."""
    flags = _flags(bars)
    by_sector = _fold(flags.join(constituents, "symbol"), ["sector"])
    everyone = constituents.select("symbol").distinct()
    whole = _fold(flags.join(everyone, "symbol", "left_semi"), [])
    return by_sector.unionByName(whole.withColumn("sector", F.lit(market)))
