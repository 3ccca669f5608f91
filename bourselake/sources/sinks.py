"""Daily outputs of a scan, partitioned by as-of date, with a run manifest."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_daily(outputs: Mapping[str, DataFrame], folder: str, as_of: str,
                skipped_modules: tuple[str, ...] = ()) -> None:
    """One dataset per output; a rerun replaces the same as-of partition only."""
    spark: SparkSession = next(iter(outputs.values())).sparkSession
    for name, df in outputs.items():
        (df.withColumn("as_of", F.lit(as_of)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("as_of")
         .parquet(f"{folder}/{name}"))
    rows = [(name, "written") for name in outputs] + [(s, "skipped") for s in skipped_modules]
    (spark.createDataFrame(rows, "module string, status string").coalesce(1)
     .withColumn("as_of", F.lit(as_of)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("as_of").json(f"{folder}/manifest"))
