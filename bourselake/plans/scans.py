"""Scans, normalisation, universe filters and set membership on the market tables."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from bourselake.functions import bool_int, r2, r4, r6, safe_div
from bourselake.operators import indicators as ind
from bourselake.operators import universe as uni
from bourselake.plans.registry import query
from bourselake.plans.views import BY, add_view, avg, lag, run
from bourselake.session import shared_dir
from bourselake.sources import normalize as nz
from bourselake.sources.readers import clean_membership, rename_and_cast
from bourselake.sources.sinks import write_daily

AS_OF = "1999-06-30"


@query("bars_scan", "bars", "SELECT UPPER(symbol) AS symbol, date, open, high, low, close, volume FROM bars")
def q_scan(m):
    delivered = m.bars.select("symbol", F.col("date").alias("Timestamp"), "Open", "High", "Low",
                              "Close", "Volume")
    return nz.scan_bars(delivered)


@query("bars_normalize", "", """
SELECT symbol, date, close, volume FROM (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, R4(l_extendedprice / l_quantity) AS close,
    l_quantity AS volume, ROW_NUMBER() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE)
      ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, R4(l_extendedprice / l_quantity) DESC) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 7) WHERE k = 1""")
def q_normalize(m):
    """Raw deliveries: several rows per symbol and day, some with an unreadable date."""
    line = m.table("lineitem").join(m.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    raw = line.select(
        F.col("p_brand").alias("Symbol"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(
            F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Date"),
        r4(F.col("l_extendedprice") / F.col("l_quantity")).alias("CLOSE"),
        F.col("l_quantity").alias("Volume"), "l_orderkey", "l_linenumber", "l_quantity")
    return nz.normalize_bars(raw, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("source_rename_cast", "", """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_extendedprice END AS close, l_quantity AS volume, COUNT(*) AS copies
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def q_rename(m):
    line = m.table("lineitem").join(m.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    vendor = line.select(
        F.col("p_brand").alias("TckrSymb"), F.date_format("l_shipdate", "dd-MM-yyyy").alias("TradDt"),
        F.when(F.col("l_returnflag") == "A", "-").otherwise(
            F.format_number("l_extendedprice", 2)).alias("ClsPric"),
        F.col("l_quantity").cast("string").alias("TtlTradgVol"))
    df = rename_and_cast(vendor, {"TckrSymb": "symbol", "TradDt": "date", "ClsPric": "close",
                                  "TtlTradgVol": "volume"}, ("close", "volume"), {"date": "dd-MM-yyyy"})
    return df.groupBy("symbol", "date", "close", "volume").agg(F.count("*").alias("copies"))


NUMBER = "CAST(REGEXP_REPLACE(symbol, '[^0-9]+', '') AS INT)"
add_view("raw_bars", "bars", f"""SELECT symbol, date, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume / f AS volume
  FROM (SELECT *, (CASE WHEN {NUMBER} % 3 = 0 AND date < DATE '1997-06-02' THEN 2 ELSE 1 END)
    * (CASE WHEN {NUMBER} % 5 = 0 AND date < DATE '1999-03-01' THEN 5 ELSE 1 END) AS f FROM bars)""")
add_view("split_gap", "raw_bars", f"""SELECT symbol, date, rr AS raw_ratio, CAST(FLOOR(rr + 0.5) AS BIGINT) AS ratio
  FROM (SELECT symbol, date, {lag('close')} / close AS rr FROM raw_bars)
  WHERE rr > 1.4 AND FLOOR(rr + 0.5) BETWEEN 2 AND 20 AND ABS(rr - FLOOR(rr + 0.5)) / FLOOR(rr + 0.5) < 0.06""")


def raw_bars(m):
    """Bars as traded before adjustment: two later splits, by symbol number."""
    number = F.regexp_replace("symbol", "[^0-9]+", "").cast("int")
    two = F.when((number % 3 == 0) & (F.col("date") < "1997-06-02"), 2).otherwise(1)
    five = F.when((number % 5 == 0) & (F.col("date") < "1999-03-01"), 5).otherwise(1)
    df = m.bars.withColumn("f", two * five)
    return df.select("symbol", "date", *[(F.col(c) * F.col("f")).alias(c)
                                         for c in ("open", "high", "low", "close")],
                     (F.col("volume") / F.col("f")).alias("volume"))


@query("split_gaps", "split_gap", "SELECT symbol, date, R6(raw_ratio) AS raw_ratio, ratio FROM split_gap")
def q_split_gaps(m):
    return nz.split_gaps(raw_bars(m)).withColumn("raw_ratio", r6("raw_ratio"))


@query("split_adjust", "raw_bars split_gap", f"""
WITH g AS (SELECT * FROM split_gap WHERE {NUMBER} % 15 <> 0 OR ratio = 5),
a AS (SELECT b.*, COALESCE(EXP(SUM(LN(g.ratio)) OVER (PARTITION BY b.symbol ORDER BY b.date
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) AS f0 FROM raw_bars b LEFT JOIN g USING (symbol, date))
SELECT symbol, date, CAST(FLOOR(f0 + 0.5) AS DOUBLE) AS factor, R4(close / FLOOR(f0 + 0.5)) AS close,
  R4(volume * FLOOR(f0 + 0.5)) AS volume FROM a""")
def q_split_adjust(m):
    """Symbols whose number is a multiple of 15 have one confirmed ratio; the others none."""
    number = F.regexp_replace("symbol", "[^0-9]+", "").cast("int")
    confirmed = m.constituents.filter(number % 15 == 0).select("symbol", F.lit(5).alias("ratio"))
    df = nz.split_adjust(raw_bars(m), confirmed)
    return df.select("symbol", "date", "factor", r4("close").alias("close"), r4("volume").alias("volume"))


@query("constituents_scan", "constituents", "SELECT sector, UPPER(symbol) AS symbol FROM constituents")
def q_constituents(m):
    part = m.table("part").select(F.concat(F.lit("  "), F.col("p_brand")).alias("symbol"))
    region = m.table("region")
    number = F.regexp_replace("symbol", "[^0-9]+", "").cast("int") % 5
    rows = part.join(region, number == F.col("r_regionkey")).select(
        F.concat(F.col("r_name"), F.lit(" ")).alias("sector"), "symbol")
    return clean_membership(rows)


@query("layered_fallback", "constituents", """
WITH layer AS (SELECT sector, symbol, 'live' AS source_layer, 0 AS k FROM constituents WHERE sector < 'ASIA'
  UNION ALL SELECT sector, symbol, 'cached', 1 FROM constituents WHERE sector < 'EUROPE'
  UNION ALL SELECT sector, symbol, 'seed', 2 FROM constituents)
SELECT sector, symbol, source_layer FROM layer l WHERE k = (SELECT MIN(k) FROM layer x WHERE x.sector = l.sector)""")
def q_layered(m):
    base = m.constituents
    return nz.layered([("live", base.filter("sector < 'ASIA'")),
                       ("cached", base.filter("sector < 'EUROPE'")), ("seed", base)], "sector")


@query("index_members", "constituents", "SELECT symbol FROM constituents WHERE sector = 'ASIA'")
def q_members(m):
    return nz.members_of(m.constituents, "ASIA").select("symbol")


@query("freshness", "bars", """SELECT MAX(date) AS latest_date, DATE_DIFF('day', MAX(date), DATE '2001-12-31') AS days_old,
  DATE_DIFF('day', MAX(date), DATE '2001-12-31') <= 5 AS is_fresh,
  CASE WHEN DATE_DIFF('day', MAX(date), DATE '2001-12-31') > 5
    THEN CONCAT('data is ', DATE_DIFF('day', MAX(date), DATE '2001-12-31'), ' days old') ELSE '' END AS warning FROM bars""")
def q_freshness(m):
    return nz.freshness(m.bars, "2001-12-31")


@query("history_upsert", "bench_index", """
WITH h AS (SELECT date AS data_date, close AS score, 0 AS k FROM bench_index WHERE date < DATE '2001-06-01'
  UNION ALL SELECT date, close + 1, 1 FROM bench_index WHERE date >= DATE '2001-05-25')
SELECT data_date, R4(ARG_MAX(score, k)) AS score FROM h GROUP BY data_date ORDER BY data_date DESC LIMIT 20""")
def q_upsert(m):
    base = m.bench_index.select(F.col("date").alias("data_date"), F.col("close").alias("score"))
    history = base.filter("data_date < '2001-06-01'")
    new = base.filter("data_date >= '2001-05-25'").withColumn(
        "score", F.col("score") + 1)
    return nz.upsert_history(history, new).withColumn("score", r4("score"))


@query("optional_table", "", "SELECT p_partkey, p_brand, p_size FROM part")
def q_optional(m):
    from bourselake.sources.readers import read_optional_table
    return read_optional_table(m.spark, f"{m.root}/part.parquet").select("p_partkey", "p_brand", "p_size")


@query("provenance", "bars", "SELECT symbol, COUNT(*) AS n_bars, 'computed' AS provenance FROM bars GROUP BY symbol")
def q_provenance(m):
    return nz.with_provenance(m.bars.groupBy("symbol").agg(F.count("*").alias("n_bars")), "computed")


add_view("monthly", "bars", """SELECT symbol, CAST(DATE_TRUNC('month', date) AS DATE) AS month, ARG_MIN(open, date) AS open,
  MAX(high) AS high, MIN(low) AS low, ARG_MAX(close, date) AS close, SUM(volume) AS volume, MAX(date) AS last_date
  FROM bars GROUP BY 1, 2""")


@query("resample_bars", "monthly", "SELECT * FROM monthly")
def q_resample(m):
    return nz.resample_monthly(m.bars)


@query("sink_daily", "bars", """SELECT symbol, date, close, '1999-06-30' AS as_of FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars WHERE date <= DATE '1999-06-30') WHERE k = 1""")
def q_sink(m):
    """Write the watchlist of one as-of date and read it back."""
    folder = os.path.join(shared_dir(m.spark), f"daily-{uuid.uuid4().hex}")
    latest = uni.latest_bar(uni.asof_cut(m.bars, AS_OF), ["close"])
    write_daily({"watchlist": latest}, folder, AS_OF, ("futures_trigger",))
    return m.spark.read.option("basePath", f"{folder}/watchlist").schema(
        "symbol string, date date, close double, as_of string").parquet(f"{folder}/watchlist")


@query("asof_cut", "bars", """SELECT symbol, COUNT(*) AS n_bars, MAX(date) AS last_date, (SELECT MAX(date) FROM bars
  WHERE date <= DATE '1999-06-30') AS target_date FROM bars WHERE date <= DATE '1999-06-30' GROUP BY symbol""")
def q_asof(m):
    return uni.asof_cut(m.bars, AS_OF).groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.max("date").alias("last_date"),
        F.max("target_date").alias("target_date"))


@query("latest_bar", "bars", """SELECT symbol, date, open, high, low, close, volume FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k = 1""")
def q_latest(m):
    return uni.latest_bar(m.bars, ["open", "high", "low", "close", "volume"])


@query("tradable_filter", "features", """SELECT symbol, date, close, R6(vol_avg20) AS vol_avg20 FROM features
  WHERE close >= 90 AND vol_avg20 >= 40 AND ma50 IS NOT NULL AND ma200 IS NOT NULL""")
def q_tradable(m):
    df = uni.tradable(ind.feature_panel(m.bars), 90.0, 40.0)
    return df.select("symbol", "date", "close", r6("vol_avg20").alias("vol_avg20"))


add_view("uni_metrics", "bars rsi14", f"""
SELECT symbol, z.close AS close, COALESCE(z.close > z.m50, FALSE) AS above_50, COALESCE(z.close > z.m200, FALSE) AS above_200,
  rsi_14, z.close / a - 1 AS ret_window, z.t / 1e7 AS turnover_cr, dl AS avg_delivery_pct
FROM (SELECT symbol, ARG_MAX(STRUCT_PACK(close := close, m50 := m50, m200 := m200, t := t), date) AS z,
  ARG_MAX(rsi, date) AS rsi_14, ARG_MIN(close, date) AS a, AVG(delivery_pct) AS dl
  FROM (SELECT b.symbol, b.date, b.close, b.delivery_pct, r.rsi, {avg('b.close', 50, by='PARTITION BY b.symbol ORDER BY b.date')} AS m50,
    {avg('b.close', 200, by='PARTITION BY b.symbol ORDER BY b.date')} AS m200,
    {avg('b.close * b.volume', 20, 1, by='PARTITION BY b.symbol ORDER BY b.date')} AS t
    FROM bars b JOIN rsi14 r ON b.symbol = r.symbol AND b.date = r.date) GROUP BY symbol)""")


@query("universe_metrics", "uni_metrics", """SELECT symbol, close, above_50, above_200, R6(rsi_14) AS rsi_14,
  R6(ret_window) AS ret_window, R6(turnover_cr * 1000) AS turnover_th, R6(avg_delivery_pct) AS avg_delivery_pct FROM uni_metrics""")
def q_metrics(m):
    df = uni.universe_metrics(m.bars)
    return df.select("symbol", "close", "above_50", "above_200", r6("rsi_14").alias("rsi_14"),
                     r6("ret_window").alias("ret_window"),
                     r6(F.col("turnover_cr") * 1000).alias("turnover_th"),
                     r6("avg_delivery_pct").alias("avg_delivery_pct"))


add_view("ratios", "financials_wide", """SELECT symbol, SUM(y2001) / NULLIF(SUM(y1998), 0) * 20 AS roce_pct,
  SUM(CASE WHEN line_item = 'R' THEN y2001 ELSE 0 END) / NULLIF(SUM(y2001), 0) AS debt_to_equity,
  (SUM(y2001) / NULLIF(SUM(y2000), 0) - 1) * 100 AS sales_growth_5y FROM financials_wide GROUP BY symbol""")


def ratios(m):
    """Three fundamental ratios per symbol from the wide statements: newest year against the one and three before."""
    newest, before, third = (f"y{max(m.years[0], m.years[-1] - back)}" for back in (0, 1, 3))

    def debt():
        return F.sum(F.when(F.col("line_item") == "R", F.col(newest)).otherwise(0.0))
    return m.financials_wide.groupBy("symbol").agg(
        (safe_div(F.sum(newest), F.sum(third)) * 20).alias("roce_pct"),
        safe_div(debt(), F.sum(newest)).alias("debt_to_equity"),
        ((safe_div(F.sum(newest), F.sum(before)) - 1) * 100).alias("sales_growth_5y"))


add_view("uni_flags", "uni_metrics ratios", """
WITH a AS (SELECT *, COALESCE(turnover_cr >= 0.0005, FALSE) AS pass_liquidity, above_50 AS pass_ma,
  COALESCE(ret_window >= -0.5, FALSE) AS pass_momentum, COALESCE(avg_delivery_pct >= 40, FALSE) AS pass_delivery FROM uni_metrics)
SELECT a.*, r.roce_pct, r.debt_to_equity, COALESCE(r.roce_pct >= 15, FALSE) AS pass_roce, COALESCE(r.debt_to_equity <= 0.6, FALSE) AS pass_debt
FROM a LEFT JOIN ratios r ON a.symbol = r.symbol AND pass_liquidity AND pass_ma AND pass_momentum AND pass_delivery""")


def universe(m):
    return uni.build_universe(uni.universe_metrics(m.bars), ratios(m), liquidity_min_cr=0.0005,
                              above_ma=50, momentum_min=-0.5, delivery_min=40.0, roce_min=15.0,
                              debt_max=0.6)


@query("build_universe", "uni_flags", """SELECT symbol, pass_liquidity, pass_ma, pass_momentum, pass_delivery, pass_roce,
  pass_debt, pass_liquidity AND pass_ma AND pass_momentum AND pass_delivery AND pass_roce AND pass_debt AS passes FROM uni_flags""")
def q_universe(m):
    return universe(m).select("symbol", "pass_liquidity", "pass_ma", "pass_momentum", "pass_delivery",
                              "pass_roce", "pass_debt", "passes")


@query("quality_gate", "uni_flags", """SELECT symbol, R4(roce_pct) AS roce_pct, R4(debt_to_equity) AS debt_to_equity FROM uni_flags
  WHERE pass_liquidity AND pass_ma AND pass_momentum AND pass_delivery AND pass_roce AND pass_debt""")
def q_quality(m):
    df = universe(m).filter("passes")
    return df.select("symbol", r4("roce_pct").alias("roce_pct"), r4("debt_to_equity").alias("debt_to_equity"))


@query("survivor_semi", "uni_flags ratios", """SELECT r.symbol, R4(sales_growth_5y) AS sales_growth_5y FROM ratios r
  WHERE symbol IN (SELECT symbol FROM uni_metrics WHERE above_200)""")
def q_survivor(m):
    alive = uni.universe_metrics(m.bars).filter("above_200").select("symbol")
    return ratios(m).join(alive, "symbol", "left_semi").select(
        "symbol", r4("sales_growth_5y").alias("sales_growth_5y"))


@query("liquidity_gate", "bars", f"""SELECT symbol, date, R2({avg('close * volume', 20)}) AS turnover_20d FROM (
  SELECT *, ROW_NUMBER() OVER ({BY}) AS rn FROM bars) QUALIFY rn >= 200 AND {avg('close * volume', 20)} >= 5000""")
def q_liquidity(m):
    from bourselake.functions import avg_full
    df = m.bars.withColumn("rn", ind.bar_number()).withColumn(
        "turnover_20d", avg_full(F.col("close") * F.col("volume"), 20))
    return df.filter("rn >= 200 AND turnover_20d >= 5000").select(
        "symbol", "date", r2("turnover_20d").alias("turnover_20d"))


@query("overbought_oversold", "bars constituents", f"""
WITH a AS (SELECT sector, date, AVG(CAST(up AS INT)) AS ratio FROM (SELECT symbol, date, COALESCE(close > {avg('close', 50)}, FALSE) AS up FROM bars)
  JOIN constituents USING (symbol) GROUP BY ALL)
SELECT sector, date, R6(ratio) AS ratio, CASE WHEN ratio > 0.37 THEN 'overbought' WHEN ratio < 0.097 THEN 'oversold' ELSE 'neutral' END AS status,
  CASE WHEN ratio > 0.8 THEN 'overbought' WHEN ratio < 0.2 THEN 'oversold' ELSE 'neutral' END AS status_wide FROM a""")
def q_overbought(m):
    from bourselake.functions import yes
    df = m.bars.select("symbol", "date", yes(F.col("close") > ind.sma("close", 50)).cast("int").alias("up"))
    df = df.join(m.constituents, "symbol").groupBy("sector", "date").agg(F.avg("up").alias("ratio"))
    return df.select("sector", "date", r6("ratio").alias("ratio"),
                     uni.overbought_label("ratio", 0.37, 0.097).alias("status"),
                     uni.overbought_label("ratio", 0.80, 0.20).alias("status_wide"))


@query("band_classify", "bars", f"""
WITH a AS (SELECT date, R6(100 * AVG(CAST(COALESCE(close > m200, FALSE) AS INT))) AS pct FROM (SELECT symbol, date, close, {avg('close', 200)} AS m200 FROM bars) GROUP BY date)
SELECT date, pct, CASE WHEN pct >= 60 THEN 'healthy' WHEN pct >= 50 THEN 'narrow_rally' WHEN pct >= 40 THEN 'caution' ELSE 'fragile' END AS breadth_class,
  CASE WHEN pct >= 73 THEN 'overbought' WHEN pct >= 60 THEN 'healthy_bullish' WHEN pct >= 40 THEN 'neutral' WHEN pct >= 23 THEN 'bearish' ELSE 'oversold' END AS short_class,
  CASE WHEN pct >= 37 THEN 'overbought' WHEN pct >= 30 THEN 'neutral_bullish' WHEN pct >= 20 THEN 'neutral' WHEN pct >= 15 THEN 'neutral_bearish' ELSE 'bearish' END AS uptrend_class FROM a""")
def q_bands(m):
    from bourselake.functions import yes
    up = yes(F.col("close") > ind.sma("close", 200)).cast("int")
    df = m.bars.select("date", up.alias("up")).groupBy("date").agg(r6(F.avg("up") * 100).alias("pct"))
    return df.select("date", "pct", uni.classify("pct", uni.BREADTH_200_CLASSES).alias("breadth_class"),
                     uni.classify("pct", uni.BREADTH_8_CLASSES).alias("short_class"),
                     uni.classify("pct", uni.UPTREND_CLASSES).alias("uptrend_class"))


@query("pct_rescale", "", """
WITH t AS (SELECT event_id, value, CASE WHEN event_id % 7 = 0 THEN CHR(CAST(65 + event_id % 6 AS INT)) WHEN event_id % 3 = 0
  THEN CAST(R4(value / 500) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS score_text FROM events)
SELECT event_id, R6(CASE WHEN ABS(value / 100) <= 1 THEN value / 100 * 100 ELSE value / 100 END) AS percent,
  R6(CASE WHEN TRY_CAST(score_text AS DOUBLE) IS NOT NULL THEN LEAST(GREATEST(CASE WHEN TRY_CAST(score_text AS DOUBLE) > 1
    THEN TRY_CAST(score_text AS DOUBLE) / 100 ELSE TRY_CAST(score_text AS DOUBLE) END, 0), 1)
    ELSE CASE score_text WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 WHEN 'C' THEN 0.6 WHEN 'D' THEN 0.4 WHEN 'F' THEN 0.2 ELSE 0 END END) AS unit FROM t""")
def q_rescale(m):
    value, number = F.col("value"), F.col("event_id")
    text = (F.when(number % 7 == 0, F.char(65 + number % 6))
            .when(number % 3 == 0, r4(value / 500).cast("string")).otherwise(value.cast("string")))
    return m.table("events").select("event_id", r6(uni.rescale_percent(value / 100)).alias("percent"),
                                    r6(uni.unit_score(text)).alias("unit"))


@query("cell_to_number", "", """SELECT o_orderkey, o_totalprice AS amount, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE R2(o_totalprice / 1e6) END AS pct FROM orders""")
def q_cells(m):
    orders = m.table("orders")
    amount = F.concat(F.lit("₹ "), F.format_number("o_totalprice", 2), F.lit(" Cr."))
    pct = F.when(F.col("o_orderstatus") == "P", "-").otherwise(
        F.concat(F.format_number(r2(F.col("o_totalprice") / 1e6), 2), F.lit(" %")))
    return orders.select("o_orderkey", uni.cell_number(amount).alias("amount"),
                         uni.cell_number(pct).alias("pct"))


@query("since_until", "bars", f"""SELECT symbol, date, R6(m200) AS ma200, close FROM (SELECT symbol, date, close, {avg('close', 200)} AS m200 FROM bars
  WHERE date >= DATE '1998-01-01' - 420 AND date <= DATE '1999-12-31') WHERE date >= DATE '1998-01-01'""")
def q_since(m):
    """Read a warm-up before the window, compute, then trim."""
    from bourselake.operators.breadth import trim, warm_slice
    df = warm_slice(m.bars, "1998-01-01", "1999-12-31").withColumn("ma200", ind.sma("close", 200))
    return trim(df, "1998-01-01").select("symbol", "date", r6("ma200").alias("ma200"), "close")
