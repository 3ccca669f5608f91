"""Streams over the event table, each run on all rows that have arrived."""
from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.functions import r4
from bourselake.plans.registry import query
from bourselake.plans.views import add_view
from bourselake.sources.market import Market
from bourselake.streaming import bars as sb


def arriving(m: Market):
    """The event table as a file stream."""
    path = f"{m.root}/events.parquet"
    table = m.spark.read.parquet(path)
    reader = m.spark.readStream.schema(table.schema)
    if any(f.endswith("/events.parquet") for f in table.inputFiles()):  # one file, not a folder
        return sb.ticks(reader.option("pathGlobFilter", "events.parquet").parquet(m.root))
    return sb.ticks(reader.parquet(path))


add_view("ticks", "", "SELECT CONCAT('Brand#', CAST(user_id % 25 + 1 AS VARCHAR)) AS symbol, ts, value AS price, event_id, event_type FROM events")
LIMIT = "(SELECT MAX(ts) - INTERVAL 1 HOUR FROM ticks)"


def naive(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("stream_bars", "ticks", f"""SELECT symbol, DATE_TRUNC('hour', ts) AS start, ARG_MIN(price, ts) AS open, MAX(price) AS high, MIN(price) AS low, ARG_MAX(price, ts) AS close, COUNT(*) AS volume FROM ticks
  GROUP BY 1, 2 HAVING DATE_TRUNC('hour', ts) + INTERVAL 1 HOUR <= {LIMIT}""")
def q_bars(m):
    df = sb.run_available(sb.hourly_bars(arriving(m)), sb.stream_folder(m.spark, "bars"))
    return df.select("symbol", naive("start"), "open", "high", "low", "close", "volume")


@query("stream_sliding", "ticks", f"""WITH w AS (SELECT symbol, price, DATE_TRUNC('hour', ts) - CAST(k AS INT) * INTERVAL 1 HOUR AS start FROM ticks, GENERATE_SERIES(0, 5) t(k))
SELECT symbol, start, COUNT(*) AS n, R4(SUM(price)) AS turnover FROM w GROUP BY 1, 2 HAVING start + INTERVAL 6 HOUR <= {LIMIT}""")
def q_sliding(m):
    df = sb.run_available(sb.sliding_volume(arriving(m)), sb.stream_folder(m.spark, "sliding"))
    return df.select("symbol", naive("start"), "n", r4("turnover").alias("turnover"))


@query("stream_sessions", "ticks", f"""WITH g AS (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY symbol ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nw FROM ticks),
s AS (SELECT *, SUM(nw) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT symbol, MIN(ts) AS start, MAX(ts) + INTERVAL 2 HOUR AS "end", COUNT(*) AS n FROM s GROUP BY symbol, k HAVING MAX(ts) + INTERVAL 2 HOUR <= {LIMIT}""")
def q_sessions(m):
    df = sb.run_available(sb.sessions(arriving(m)), sb.stream_folder(m.spark, "sessions"))
    return df.select("symbol", naive("start"), naive("end"), "n")


@query("stream_anomaly")
def q_anomaly(m):
    return sb.run_available(sb.ewm_anomalies(arriving(m)), sb.stream_folder(m.spark, "anomaly"))


def in_batches(m: Market, folder: str, parts: int = 4):
    """The event table as files in order of time, one batch each."""
    events = m.spark.read.parquet(f"{m.root}/events.parquet")
    events.repartitionByRange(parts, "ts", "event_id").write.parquet(f"{folder}/input")
    return sb.ticks(m.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/input"))


@query("stream_dedupe", "ticks", "SELECT symbol, event_type, MAX(ts) AS ts, ARG_MAX(price, ROW(ts, event_id)) AS price, ARG_MAX(event_id, ROW(ts, event_id)) AS event_id FROM ticks GROUP BY 1, 2")
def q_dedupe(m):
    """The latest event per key over several batches."""
    folder = sb.stream_folder(m.spark, "dedupe")
    df = sb.upserted(in_batches(m, folder), folder, ["symbol", "event_type"], "struct(ts, event_id)")
    return df.select("symbol", "event_type", naive("ts"), "price", "event_id")


@query("stream_enrich", "ticks constituents", "SELECT c.sector, t.event_type, COUNT(*) AS n FROM ticks t JOIN constituents c USING (symbol) GROUP BY 1, 2")
def q_enrich(m):
    df = sb.run_available(sb.enrich(arriving(m), m.constituents), sb.stream_folder(m.spark, "enrich"))
    return df.groupBy("sector", "event_type").agg(F.count("*").alias("n"))


@query("stream_outcomes", "ticks", f"""
WITH d AS (SELECT symbol, DATE_TRUNC('day', ts) + INTERVAL 1 DAY AS e, ARG_MAX(price, ts) AS close FROM ticks GROUP BY 1, DATE_TRUNC('day', ts)), b AS (SELECT * FROM d WHERE e <= {LIMIT})
SELECT t.event_id, b.e AS "end", b.close FROM ticks t JOIN b ON b.symbol = t.symbol AND b.e BETWEEN t.ts + INTERVAL 5 DAY AND t.ts + INTERVAL 9 DAY""")
def q_outcomes(m):
    bars = sb.hourly_bars(arriving(m), size="1 day")
    df = sb.run_available(sb.outcomes(arriving(m), bars), sb.stream_folder(m.spark, "outcomes"))
    return df.select("event_id", naive("end"), "close")


@query("resume", "ticks", "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids FROM ticks GROUP BY 1")
def q_resume(m):
    """A run that breaks off in its second batch, rows written but not committed, and one that goes on from there."""
    folder = sb.stream_folder(m.spark, "resume")
    stream = in_batches(m, folder)
    sb.upserted(stream, folder, ["event_id"], "ts", fail_at=1)
    df = sb.upserted(stream, folder, ["event_id"], "ts")
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
