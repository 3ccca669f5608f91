"""The market tables, derived from the raw star schema.

`bars` holds one row per symbol and calendar date: the raw rows are folded by a partial
aggregation first, so a symbol that owns a third of the raw table still ends up with at most
one row per trading date, and windows by symbol stay bounded by the calendar.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bourselake.functions import r2, r4, running

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def symbol_of(number) -> F.Column:
    """Ticker for a number: 25 symbols, matching the brands."""
    return F.concat(F.lit("Brand#"), (number % 25 + 1).cast("string"))


class Market:
    """Lazy DataFrames over one data folder; nothing runs until a sink acts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        line = self.table("lineitem").select(
            "l_partkey", F.to_date("l_shipdate").alias("date"), "l_quantity", "l_discount",
            "l_tax", (F.col("l_returnflag") == "N").cast("double").alias("is_new"))
        """Quantities per symbol and line item, one column per year of the data."""
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("symbol"))
        daily = (line.join(part, F.col("l_partkey") == F.col("p_partkey"))
                 .groupBy("symbol", "date")
                 .agg(F.sum("l_quantity").alias("volume"), F.count("*").alias("trades"),
                      F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"),
                      F.avg("is_new").alias("n")))
        by_date = Window.partitionBy("symbol").orderBy("date")
        path = daily.withColumn("c", F.lit(100.0) * F.exp(
            F.sum((F.col("d") - F.lit(0.05)) * F.lit(0.6) + F.lit(0.0004)).over(running())))
        path = path.withColumn("op", F.coalesce(F.lag("c").over(by_date), F.lit(100.0))
                               * (F.lit(1.0) + (F.col("t") - F.lit(0.04)) * F.lit(0.25)))
        top, bottom = F.greatest("op", "c"), F.least("op", "c")
        return path.select(
            "symbol", "date", r4("op").alias("open"),
            r4(top * (F.lit(1.0) + F.col("t") * F.lit(0.1))).alias("high"),
            r4(bottom * (F.lit(1.0) - F.col("t") * F.lit(0.1))).alias("low"),
            r4("c").alias("close"), "volume", "trades",
            (F.floor(F.lit(1000000.0) * F.col("n") + F.lit(0.50001)) / F.lit(10000.0))
            .alias("delivery_pct"))

    @cached_property
    def constituents(self) -> DataFrame:
        part = self.table("part").select(F.col("p_brand").alias("symbol")).distinct()
        number = F.regexp_replace("symbol", "[^0-9]+", "").cast("int") % 5
        region = self.table("region")
        return (part.join(region, number == F.col("r_regionkey"))
                .select(F.col("r_name").alias("sector"), "symbol"))

    @cached_property
    def bench_index(self) -> DataFrame:
        prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
        mean = (self.bars.select("date", "close", prev.alias("pc")).filter("pc IS NOT NULL")
                .groupBy("date").agg(F.avg(F.ln(F.col("close") / F.col("pc"))).alias("m")))
        # one row per calendar date, so the unpartitioned running sum is small by construction
        grown = F.exp(F.sum("m").over(running([], "date")))
        return mean.select("date", (F.floor(F.lit(1000000.0) * grown + F.lit(0.50001))
                                    / F.lit(10000.0)).alias("close"))

    @cached_property
    def flows(self) -> DataFrame:
        price, filled = F.col("o_totalprice"), F.col("o_orderstatus") == "F"
        return (self.table("orders")
                .groupBy(F.to_date("o_orderdate").alias("date"),
                         F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "FII")
                         .otherwise("DII").alias("category"))
                .agg(r2(F.sum(F.when(filled, price).otherwise(0.0))).alias("buy_value"),
                     r2(F.sum(F.when(~filled, price).otherwise(0.0))).alias("sell_value")))

    @cached_property
    def signals(self) -> DataFrame:
        value = F.col("value")
        return self.table("events").select(
            F.col("event_id").alias("signal_ref"), F.col("event_type").alias("skill"),
            symbol_of(F.col("user_id")).alias("ticker"),
            F.when(value >= 50, "LONG").when(value >= 10, "SHORT").otherwise("NEUTRAL")
            .alias("direction"),
            r4(F.least(value / F.lit(200.0), F.lit(1.0))).alias("raw_score"),
            F.date_add(F.lit("1998-01-01").cast("date"),
                       (F.col("event_id") % 1000).cast("int")).alias("signal_date"), "ts")

    @cached_property
    def rates(self) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        return (self.table("orders").groupBy(F.to_date("o_orderdate").alias("date"))
                .agg((F.lit(2.0) + F.lit(3.0) * F.avg(
                    (F.col("o_orderstatus") == "F").cast("double"))).alias("year2"),
                     (F.lit(2.0) + F.lit(3.0) * F.avg(
                         first.isin("1", "2", "3").cast("double"))).alias("year10")))

    @cached_property
    def news(self) -> DataFrame:
        """News items; title is the first line, body the whole text."""
        return self.table("documents").select(
            F.col("doc_id").alias("news_id"), F.split("text", "\n")[0].alias("title"),
            F.col("text").alias("body"), "source", "lang",
            symbol_of(F.col("doc_id")).alias("symbol"),
            F.date_add(F.lit("1998-01-01").cast("date"),
                       (F.col("doc_id") % 1000).cast("int")).alias("published"))

    @cached_property
    def financials_wide(self) -> DataFrame:
        """Quantities per symbol and line item, one column per year of the data."""
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("symbol"))
        year = F.year("l_shipdate")
        return (self.table("lineitem")
                .select("l_partkey", "l_returnflag", "l_quantity", year.alias("y"))
                .join(part, F.col("l_partkey") == F.col("p_partkey"))
                .groupBy("symbol", F.col("l_returnflag").alias("line_item"))
                .agg(*[F.sum(F.when(F.col("y") == y, F.col("l_quantity")).otherwise(0.0))
                       .alias(f"y{y}") for y in self.years]))

    @cached_property
    def years(self) -> tuple[int, ...]:
        """All years from the first to the last line item."""
        year = F.year("l_shipdate")
        first, last = self.table("lineitem").agg(F.min(year), F.max(year)).first()
        return tuple(range(first, last + 1)) if first else ()
