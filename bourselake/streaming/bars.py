"""Event-time forms of the bar, signal and news operators.

Sinks are append-only Parquet with a checkpoint in the shared folder, so a restarted query goes on
where it stopped and writes nothing twice.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselake.session import shared_dir


def stream_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process what has arrived, then read the sink. Call again with the same folder to resume."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/data")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")


def ticks(events: DataFrame) -> DataFrame:
    """(symbol, ts, price, size) from raw events."""
    return events.select(F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("symbol"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id", "event_type")


def hourly_bars(stream: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Completed bars only: a bar leaves when the watermark has passed its end."""
    bar = F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy("symbol", bar).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.count("*").alias("volume")).select(
        "symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "open", "high", "low", "close", "volume")


def sliding_volume(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts over six hours, every hour."""
    return stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", "6 hours", "1 hour")).agg(
        F.count("*").alias("n"), F.sum("price").alias("turnover")).select("symbol", F.col("window.start").alias("start"), "n", "turnover")


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(
        "symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_once(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row per key within the watermark; later copies and late rows are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


BUCKETS = 32


def upsert_latest(spark: SparkSession, folder: str, keys: list[str], order: str | Column, buckets: int = BUCKETS):
    """foreachBatch writer that keeps the latest row per key in a table of key buckets.

    A batch rewrites only the buckets its keys fall into, as versions numbered by the batch; a manifest that names the
    version of every bucket is written last. So a batch that is replayed after a failure, before or after its manifest,
    writes the same again, and readers see whole batches only. Versions that neither this manifest nor the one before it
    names are removed.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        columns = [c for c in batch.columns if c not in keys]
        spark = batch.sparkSession  # a stream runs in a session of its own
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        before = manifest(spark, folder, epoch - 1)
        touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # `buckets` numbers at most
        paths = [version(folder, b, before[b]) for b in touched if b in before]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*paths)) if paths else batch
        value = F.expr(order) if isinstance(order, str) else order
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), value).alias("r")).select(*keys, "r.*").select(*batch.columns)
        dealt = last.withColumns({"bucket": bucket, "epoch": F.lit(epoch)})
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(f"{folder}/data")
        now = {**before, **dict.fromkeys(touched, epoch)}
        spark.createDataFrame(list(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/epoch={epoch}")
        older = manifest(spark, folder, epoch - 2)
        for b, v in older.items():
            if v not in (before.get(b), now.get(b)):
                remove(spark, version(folder, b, v))
    return write


def version(folder: str, bucket: int, epoch: int) -> str:
    return f"{folder}/data/bucket={bucket}/epoch={epoch}"


def manifest(spark: SparkSession, folder: str, epoch: int | None = None) -> dict[int, int]:
    """Version per bucket of the newest manifest, or of the newest up to an epoch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    done = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path)
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    done = [e for e in done if epoch is None or e <= epoch]
    if not done:
        return {}
    rows = spark.read.schema("bucket int, version int").parquet(f"{folder}/manifest/epoch={max(done)}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def latest(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table as the newest manifest has it."""
    paths = [version(folder, b, v) for b, v in manifest(spark, folder).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


class Interrupted(RuntimeError):
    """Raised inside a batch to stand for a lost driver."""


def upserted(stream: DataFrame, folder: str, keys: list[str], order: str, fail_at: int | None = None) -> DataFrame:
    """Runs what has arrived into the table and reads it. `fail_at` breaks off within that batch, its rows written but not
    committed; call again with the same folder to go on."""
    spark = stream.sparkSession
    put = upsert_latest(spark, folder, keys, order)

    def batch(rows: DataFrame, epoch: int) -> None:
        put(rows, epoch)
        if epoch == fail_at:
            raise Interrupted(f"batch {epoch}")
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if fail_at is None:
            raise
    return latest(spark, folder, stream.schema)


def enrich(stream: DataFrame, constituents: DataFrame) -> DataFrame:
    """Stream-static join; the size-checked planner decides on broadcasting."""
    return stream.join(constituents, "symbol")


def outcomes(signals: DataFrame, bars: DataFrame, first_days: int = 5, last_days: int = 9) -> DataFrame:
    """Signals with the daily bars that close from five to nine days later.

    `signals(symbol, ts, event_id)`, `bars(symbol, end, close)`; both sides are bounded in state.
    """
    s = signals.withWatermark("ts", "1 hour").select("symbol", "ts", "event_id")
    b = bars.select(F.col("symbol").alias("bar_symbol"), "end", "close")
    near = F.expr(f"end >= ts + INTERVAL {first_days} DAYS AND end <= ts + INTERVAL {last_days} DAYS")
    return s.join(b, (F.col("symbol") == F.col("bar_symbol")) & near).select("event_id", "symbol", "ts", "end", "close")


def ewm_anomalies(stream: DataFrame, alpha: float = 0.06, z_min: float = 2.0) -> DataFrame:
    """Running mean and variance per symbol, kept as state; rows that deviate by z_min are emitted.

    The state of a key is three numbers; its rows arrive in chunks and are never collected.
    """
    def update(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, var = state.get if state.exists else (0, 0.0, 0.0)
        for chunk in chunks:
            chunk = chunk.sort_values("ts")
            rows = []
            for ts, price, ident in zip(chunk["ts"], chunk["price"], chunk["event_id"]):
                if n >= 30 and var > 0 and abs(price - mean) >= z_min * var ** 0.5:
                    rows.append((key[0], ident, ts, float(price), (price - mean) / var ** 0.5))
                step = price - mean
                mean, var = (float(price), 0.0) if n == 0 else (mean + alpha * step, (1 - alpha) * (var + alpha * step * step))
                n += 1
            yield pd.DataFrame(rows, columns=["symbol", "event_id", "ts", "price", "z"])
        state.update((n, float(mean), float(var)))
    return stream.select("symbol", "event_id", "ts", "price").groupBy("symbol").applyInPandasWithState(
        update, "symbol string, event_id long, ts timestamp, price double, z double", "n long, mean double, var double",
        "append", "NoTimeout")
