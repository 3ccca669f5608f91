"""Rule-based candidate scanners over the feature panel, all relational."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import clamp, r2, safe_div, yes
from bourselake.operators.indicators import average_rank_pct, rolling_z
from bourselake.operators.pairs import average_pair_correlation, last_dates
from bourselake.operators.sectors import realized_vol
from bourselake.operators.universe import tradable

# Regime parts of the scores (RiskOn, Neutral, RiskOff).
REGIME_POINTS = {"pivot_breakout": (10.0, 5.0, -5.0), "gap_up_continuation": (8.0, 4.0, -8.0),
                 "panic_reversal": (2.0, 7.0, 12.0)}
# Hypothesis and mechanism per entry family.
FAMILIES = {"pivot_breakout": ("breakout", "behavior"),
            "gap_up_continuation": ("earnings_drift", "structure"),
            "panic_reversal": ("panic_reversal", "behavior"),
            "news_reaction": ("news_reaction", "behavior")}
HINT_SYMBOL, HINT_ANY, HINT_CAP = 12.0, 6.0, 20.0


def regime_breadth(panel: DataFrame) -> DataFrame:
    """Share above both means and the mean return, over names with both means present."""
    return panel.filter("ma50 IS NOT NULL AND ma200 IS NOT NULL").groupBy("date").agg(
        F.avg((F.col("close") > F.col("ma50")).cast("int")).alias("pct_above_ma50"),
        F.avg((F.col("close") > F.col("ma200")).cast("int")).alias("pct_above_ma200"),
        F.avg("ret_1d").alias("avg_ret"))


def tradable_at(panel: DataFrame, target: Column, min_price: float, min_volume: float) -> DataFrame:
    """Tradable names of the target date with their strength percentile."""
    day = tradable(panel.filter(F.col("date") == target), min_price, min_volume)
    return day.withColumn("rs_rank_pct", average_rank_pct("rs_120"))


def market_regime(panel: DataFrame, today: DataFrame, target: Column, benchmark: str,
                  blocks: int = 8) -> DataFrame:
    """One row: breadth, correlation, volatility, both risk scores and the label."""
    returns = panel.select("symbol", "date", "ret_1d")
    corr = average_pair_correlation(returns.join(last_dates(panel, 20, target), "date"), blocks)
    vol = realized_vol(returns, last_dates(panel, 60, target), benchmark)
    breadth = today.agg(
        F.countDistinct("symbol").alias("universe_count"),
        F.avg((F.col("close") > F.col("ma50")).cast("int")).alias("pct_above_ma50"),
        F.avg((F.col("close") > F.col("ma200")).cast("int")).alias("pct_above_ma200"))
    bench = panel.filter((F.col("symbol") == benchmark) & (F.col("date") == target)).agg(
        F.struct(F.max(F.col("close") > F.col("ma200")).alias("above"),
                 F.max("ret_1d").alias("ret")).alias("b"))
    vols = vol.select(F.struct("rv20", "rv60", "vol_trend").alias("v"))
    df = (breadth.withColumn("avg_pair_corr_20", corr.select("avg_pair_corr").scalar())
          .withColumn("v", vols.scalar()).withColumn("b", bench.scalar()))
    df = df.select("*", "v.*").withColumn(
        "bench_above_ma200", F.coalesce(F.col("b.above"), F.col("pct_above_ma200") >= 0.5)).withColumn(
        "bench_ret_1d", F.col("b.ret")).drop("v", "b")
    c, v, p = F.coalesce("avg_pair_corr_20", F.lit(0.5)), F.coalesce("vol_trend", F.lit(1.0)), F.col("pct_above_ma50")
    above = F.col("bench_above_ma200")
    on = (F.when(above, 25.0).otherwise(5.0) + clamp((p - 0.35) / 0.45) * 35
          + clamp((F.lit(0.8) - c) / 0.6) * 20 + clamp((F.lit(1.4) - v) / 0.8) * 20)
    off = (F.when(above, 5.0).otherwise(20.0) + clamp((c - 0.35) / 0.45) * 30
           + clamp((v - 0.95) / 0.8) * 30 + clamp((F.lit(0.55) - p) / 0.45) * 20)
    df = df.withColumn("risk_on_score", on).withColumn("risk_off_score", off)
    on, off = F.col("risk_on_score"), F.col("risk_off_score")
    return df.withColumn("regime_label", F.when((off >= 65) & (off - on >= 5), "RiskOff").when(
        (on >= 65) & (on >= off), "RiskOn").otherwise("Neutral"))


# -- hints -------------------------------------------------------------------------------------
def hint_boosts(hints: DataFrame) -> DataFrame:
    """Points per (family, symbol); symbol is null for hints that name no symbol.

    Hints are folded to sums before they meet the candidates, so no theta join is needed.
    """
    named = hints.filter(F.size("symbols") > 0).select(
        "entry_family", F.explode(F.array_distinct("symbols")).alias("symbol"))
    anyone = hints.filter(F.size("symbols") == 0).select(
        "entry_family", F.lit(None).cast("string").alias("symbol"))
    points = F.when(F.col("symbol").isNull(), HINT_ANY).otherwise(HINT_SYMBOL)
    return named.unionByName(anyone).groupBy("entry_family", "symbol").agg(
        F.sum(points).alias("points"), F.count("*").alias("n_hints"))


def with_hint_boost(candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """`hint_boost` (capped) and the number of matching hints per candidate."""
    boosts = hint_boosts(hints)
    own = boosts.filter("symbol IS NOT NULL").withColumnsRenamed({"points": "_p1", "n_hints": "_n1"})
    wide = boosts.filter("symbol IS NULL").select(
        "entry_family", F.col("points").alias("_p2"), F.col("n_hints").alias("_n2"))
    df = candidates.join(own, ["entry_family", "symbol"], "left").join(wide, "entry_family", "left")
    zero = F.lit(0.0)
    return (df.withColumn("hint_boost", F.least(
        F.coalesce("_p1", zero) + F.coalesce("_p2", zero), F.lit(HINT_CAP)))
        .withColumn("n_hints", F.coalesce("_n1", F.lit(0)) + F.coalesce("_n2", F.lit(0)))
        .drop("_p1", "_p2", "_n1", "_n2"))


# -- scanners ------------------------------------------------------------------------------------
def _regime_points(family: str, label: Column) -> Column:
    on, neutral, off = REGIME_POINTS[family]
    return F.when(label == "RiskOn", on).when(label == "Neutral", neutral).when(
        label == "RiskOff", off).otherwise(0.0)


def _priority(score: Column) -> Column:
    return r2(clamp(score, 0.0, 100.0))


def _part(c: Column, weight: float) -> Column:
    return clamp(F.coalesce(c, F.lit(0.0))) * F.lit(weight)


def _tag(df: DataFrame, family: str) -> DataFrame:
    hypothesis, mechanism = FAMILIES[family]
    return (df.withColumn("entry_family", F.lit(family))
            .withColumn("hypothesis_type", F.lit(hypothesis))
            .withColumn("mechanism_tag", F.lit(mechanism)))


CARRY = ("symbol", "entry_family", "hypothesis_type", "mechanism_tag", "priority_score",
         "holding_horizon", "n_hints", "close", "gap", "rel_volume", "close_pos", "rs_rank_pct",
         "ret_1d")


def breakout(today: DataFrame, label: Column, hints: DataFrame, rel_volume: float = 1.5,
             close_pos: float = 0.55, rank: float = 0.70) -> DataFrame:
    """New 20-day highs in an uptrend with volume, strong close and relative strength."""
    hit = today.filter((F.col("close") > F.col("ma50")) & (F.col("ma50") > F.col("ma200"))
                       & (F.col("close") > F.col("high20_prev")) & (F.col("rel_volume") >= rel_volume)
                       & (F.col("close_pos") >= close_pos) & (F.col("rs_rank_pct") >= rank))
    df = with_hint_boost(_tag(hit, "pivot_breakout"), hints)
    strength = safe_div("close", "high20_prev") - 1
    score = (_part(F.col("rs_rank_pct"), 40) + _part(F.col("rel_volume") / 3, 20)
             + _part(strength / 0.08, 20) + _part(F.col("close_pos"), 10)
             + _regime_points("pivot_breakout", label) + F.col("hint_boost")
             - _part((F.col("atr_pct") - 0.08) / 0.07, 15))
    return df.withColumn("holding_horizon", F.lit("20D")).withColumn(
        "priority_score", _priority(score)).select(*CARRY)


def gap_up(today: DataFrame, label: Column, hints: DataFrame, gap: float = 0.04,
           rel_volume: float = 2.0, close_pos: float = 0.50) -> DataFrame:
    """Gaps held into the close on heavy volume."""
    hit = today.filter((F.col("gap") >= gap) & (F.col("rel_volume") >= rel_volume)
                       & (F.col("close_pos") >= close_pos) & (F.col("close") > F.col("ma50")))
    df = with_hint_boost(_tag(hit, "gap_up_continuation"), hints)
    trend = sum((F.when((F.col("close") > F.col(m)) & (F.col(m) > 0), 10.0).otherwise(0.0)
                 for m in ("ma50", "ma200")), F.lit(0.0))
    score = (_part(F.col("gap") / 0.12, 35) + _part(F.col("rel_volume") / 4, 25)
             + _part(F.col("close_pos"), 20) + trend + _regime_points("gap_up_continuation", label)
             + F.col("hint_boost") - _part((F.col("atr_pct") - 0.10) / 0.08, 10))
    return df.withColumn("holding_horizon", F.lit("20D")).withColumn(
        "priority_score", _priority(score)).select(*CARRY)


def reversal(today: DataFrame, label: Column, hints: DataFrame, drop: float = -0.07,
             rel_volume: float = 1.8, floor: float = 0.85) -> DataFrame:
    """Panic days on volume while the long trend is not broken."""
    hit = today.filter((F.col("ret_1d") <= drop) & (F.col("rel_volume") >= rel_volume)
                       & (F.col("close") > F.col("ma200") * floor))
    df = with_hint_boost(_tag(hit, "panic_reversal"), hints)
    score = (_part(-F.col("ret_1d") / 0.18, 45) + _part(F.col("rel_volume") / 4, 20)
             + F.when(F.col("close") > F.col("ma200"), 15.0).otherwise(5.0)
             + _regime_points("panic_reversal", label) + F.col("hint_boost") * 0.6
             - _part((F.col("atr_pct") - 0.14) / 0.10, 12))
    return df.withColumn("holding_horizon", F.lit("5D")).withColumn(
        "priority_score", _priority(score)).select(*CARRY)


def regime_shift(panel: DataFrame, regime: DataFrame, target: Column, delta: float = 0.08,
                 calm: float = 1.05, stress: float = 1.10) -> DataFrame:
    """At most one row: breadth inflecting over eight dates with volatility agreeing."""
    daily = regime_breadth(panel.filter(F.col("date") <= target)).dropna()
    # one row per calendar date
    k = F.row_number().over(Window.orderBy(F.desc("date")))
    tail = daily.withColumn("k", k).agg(
        F.max("date").alias("date"), F.count("*").alias("n"),
        F.max(F.when(F.col("k") == 1, F.col("pct_above_ma50"))).alias("now"),
        F.max_by("pct_above_ma50", F.when(F.col("k") <= 8, F.col("k"))).alias("then"),
        F.sum(F.when(F.col("k") <= 5, F.col("avg_ret"))).alias("ret_5d"))
    trend = regime.select("vol_trend").scalar()
    known = regime.select(F.col("avg_pair_corr_20").isNotNull() & F.col("vol_trend").isNotNull()).scalar()
    tail = tail.filter((F.col("date") == target) & (F.col("n") >= 12)).select(
        (F.col("now") - F.col("then")).alias("breadth_delta"), "ret_5d", trend.alias("vol_trend"),
        known.alias("known"))
    up = (F.col("breadth_delta") >= delta) & (F.col("ret_5d") > 0) & (F.col("vol_trend") <= calm)
    down = (F.col("breadth_delta") <= -delta) & (F.col("ret_5d") < 0) & (F.col("vol_trend") >= stress)
    size = F.lit(55.0) + clamp((F.abs("breadth_delta") - delta) / 0.12) * 25
    return tail.filter(F.col("known") & (up | down)).select(
        F.lit("MARKET_BASKET").alias("symbol"), F.lit("regime_shift").alias("hypothesis_type"),
        F.lit("structure").alias("mechanism_tag"), _priority(size).alias("priority_score"),
        F.lit("60D").alias("holding_horizon"), "breadth_delta", "ret_5d",
        F.when(up, "risk_on_transition").otherwise("risk_off_transition").alias("direction"))


def leader_followers(panel: DataFrame, today: DataFrame, target: Column, leader_move: float = 0.045,
                     follower_move: float = 0.015, min_corr: float = 0.25, universe: int | None = None,
                     leaders: int = 6, followers: int = 5, days: int = 90) -> DataFrame:
    """Names that tend to follow today's strongest movers by one date and have not moved yet.

    At most `leaders` movers lead, so the join has leaders x names x days rows. The universe is every traded name,
    or the `universe` most traded ones where that is given.
    """
    dates = last_dates(panel, days, target)
    recent = panel.join(dates, "date")
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    traded = recent.withColumn("k", newest).filter("k <= 20").groupBy("symbol").agg(
        F.avg(F.col("close") * F.col("volume")).alias("dv"))
    top = (traded if universe is None else traded.orderBy(F.desc("dv"), "symbol").limit(universe)).select("symbol")
    base = recent.join(top, "symbol", "left_semi").select("symbol", "date", "ret_1d")
    movers = (today.filter(F.abs("ret_1d") >= leader_move).join(top, "symbol", "left_semi")
              .orderBy(F.desc(F.abs("ret_1d")), "symbol").limit(leaders)
              .select(F.col("symbol").alias("leader"), F.col("ret_1d").alias("leader_ret")))
    # the leader's value of the previous panel date
    order = base.select("date").distinct().withColumn(
        "next_date", F.lead("date").over(Window.orderBy("date")))
    led = (base.join(movers, F.col("symbol") == F.col("leader")).drop("symbol").join(order, "date")
           .select("leader", "leader_ret", F.col("next_date").alias("date"), F.col("ret_1d").alias("x")))
    both = base.join(led.filter("x IS NOT NULL"), "date").filter("symbol <> leader AND ret_1d IS NOT NULL")
    corr = both.groupBy("leader", "leader_ret", "symbol").agg(F.corr("ret_1d", "x").alias("lag_corr"))
    rank = F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("lag_corr"), "symbol"))
    best = corr.filter((F.col("lag_corr") >= min_corr) & ~F.isnan("lag_corr")).withColumn(
        "follower_rank", rank).filter(F.col("follower_rank") <= followers)
    quiet = today.select("symbol", "ret_1d", "rel_volume", "close", "ma50").filter(
        F.abs("ret_1d") < follower_move)
    score = (_part(F.abs("leader_ret") / 0.12, 40) + _part(F.col("lag_corr") / 0.60, 35)
             + _part(F.col("rel_volume") / 3, 15)
             + F.when(F.col("close") > F.col("ma50"), 10.0).otherwise(4.0))
    return best.join(quiet, "symbol").withColumn("priority_score", _priority(score)).select(
        "symbol", "leader", "leader_ret", "lag_corr", "follower_rank", "priority_score")


def best_per_key(df: DataFrame, key: str, score: str, *ties: str) -> DataFrame:
    """Highest-scored row per key; a mergeable maximum, so a hot key folds on the map side."""
    columns = [c for c in df.columns if c not in (key, score, *ties)]
    order = F.struct(F.col(score), *[F.col(t) for t in ties], *[F.col(c) for c in columns])
    if not ties:
        return df.groupBy(key).agg(F.max(order).alias("r")).select(key, "r.*")
    # smallest tie value wins among equal scores
    best = df.groupBy(key).agg(F.max(score).alias(score))
    tied = df.join(best, [key, score])
    return tied.groupBy(key, score).agg(
        F.min(F.struct(*[F.col(t) for t in ties], *[F.col(c) for c in columns])).alias("r")).select(
        key, score, "r.*")


def correlation_chain(pairs: DataFrame, top_n: int = 4) -> DataFrame:
    best = best_per_key(pairs.select("symbol", "priority_score", "leader", "lag_corr"), "symbol",
                        "priority_score", "leader")
    return best.orderBy(F.desc("priority_score"), "symbol").limit(top_n)


def calendar_anomaly(season: DataFrame, today: DataFrame, target: Column, mean_min: float = 0.025,
                     win_min: float = 0.6, least: int = 6, top_n: int = 3) -> DataFrame:
    """Seasonally strong names of the target month, scored with strength and volume."""
    strong = season.filter((F.col("month_num") == F.month(target)) & (F.col("sample_count") >= least)
                           & (F.col("mean_ret") >= mean_min) & (F.col("win_rate") >= win_min))
    score = (_part(F.col("mean_ret") / 0.10, 45) + _part(F.col("win_rate"), 30)
             + _part(F.col("rs_rank_pct"), 15) + _part(F.col("rel_volume") / 2.5, 10))
    df = strong.join(today.select("symbol", "rs_rank_pct", "rel_volume"), "symbol")
    return df.withColumn("priority_score", _priority(score)).orderBy(
        F.desc("priority_score"), "symbol").limit(top_n).select(
        "symbol", "priority_score", "mean_ret", "win_rate", "sample_count")


def news_reaction(reactions: DataFrame, today: DataFrame, target: Column, top_n: int = 4) -> DataFrame:
    """Largest absolute reactions of the day, with the day's features where tradable."""
    day = reactions.filter((F.col("date") == target) & F.col("reaction_1d").isNotNull())
    day = day.orderBy(F.desc(F.abs("reaction_1d")), "symbol", "news_id").limit(top_n)
    df = day.join(today.select("symbol", "rel_volume", "close_pos", "atr_pct"), "symbol", "left")
    score = _part(F.abs("reaction_1d") / 0.12, 70) + F.lit(20.0)
    return _tag(df, "news_reaction").withColumn("priority_score", _priority(score)).withColumn(
        "holding_horizon", F.lit("10D"))


def futures_trigger(futures: DataFrame, mapping: DataFrame, target: Column, z_min: float = 2.0,
                    top_n: int = 6) -> DataFrame:
    """Futures whose return is extreme today, spread to the stocks they map to.

    `futures(symbol, date, close)`, `mapping(future, stocks array)`.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    df = futures.withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    df = df.withColumn("z", rolling_z("r")).filter((F.col("date") == target) & (F.abs("z") >= z_min))
    linked = mapping.select(F.col("future").alias("symbol"), F.explode("stocks").alias("stock"))
    score = _part(F.abs("z") / 4, 60) + F.lit(20.0)
    return df.join(linked, "symbol").select(
        F.upper("stock").alias("symbol"), F.col("symbol").alias("future"), "z",
        _priority(score).alias("priority_score")).orderBy(
        F.desc("priority_score"), "symbol").limit(top_n)


ANOMALY_METRICS = ("ret_1d", "rel_volume", "gap", "atr_pct")


def anomalies(today: DataFrame, regime: DataFrame, threshold: float = 2.0, top_k: int = 10
              ) -> DataFrame:
    """Extreme metric scores of the day in long form, market-wide combinations first."""
    stack = ", ".join(f"'{c}', {c}, {c}_z" for c in ANOMALY_METRICS)
    stock = today.selectExpr("symbol", f"stack(4, {stack}) AS (metric, value, z)").filter(
        F.abs("z") >= threshold).select(F.lit("stock").alias("scope"), "symbol", "metric", "value", "z",
                                        F.abs("z").alias("abs_z"))
    combo = ((F.col("avg_pair_corr_20") >= 0.65) & (F.col("vol_trend") >= 1.15)
             & (F.col("pct_above_ma50") <= 0.40))
    diverging = (F.col("pct_above_ma50") <= 0.35) & (F.col("bench_ret_1d") > 0.003)

    def market(cond: Column, metric: str, value: str, weight: float) -> DataFrame:
        return regime.filter(yes(cond)).select(
            F.lit("market").alias("scope"), F.lit("MARKET").alias("symbol"),
            F.lit(metric).alias("metric"), F.col(value).alias("value"),
            F.lit(None).cast("double").alias("z"), F.lit(weight).alias("abs_z"))
    rows = (stock.unionByName(market(combo, "riskoff_combo", "vol_trend", 99.0))
            .unionByName(market(diverging, "breadth_divergence", "pct_above_ma50", 95.0)))
    first = F.when(F.col("metric") == "breadth_divergence", 0).when(
        F.col("metric") == "riskoff_combo", 1).otherwise(2)
    return rows.orderBy(first, F.desc("abs_z"), "symbol", "metric").limit(top_k)


def union_candidates(*scans: DataFrame) -> DataFrame:
    """All scanners stacked; columns a scanner lacks are null."""
    out = scans[0]
    for scan in scans[1:]:
        out = out.unionByName(scan, allowMissingColumns=True)
    return out


def watchlist(candidates: DataFrame, top_n: int) -> DataFrame:
    return candidates.orderBy(F.desc("priority_score"), "symbol", "hypothesis_type").limit(top_n)


def tickets(candidates: DataFrame, regime: DataFrame, as_of: str) -> DataFrame:
    """Nested research tickets; candidates without an entry family are research only."""
    tag = F.when(F.col("entry_family") == "pivot_breakout", "vcp").when(
        F.col("entry_family") == "gap_up_continuation", "gap").otherwise(F.col("hypothesis_type"))
    ident = F.lower(F.regexp_replace(F.concat_ws(
        "_", F.lit("edge_auto"), tag, F.col("symbol"), F.lit(as_of.replace("-", ""))), "[^a-zA-Z0-9]+", "_"))
    market = regime.select(F.struct(
        F.col("regime_label").alias("regime"), "pct_above_ma50", "avg_pair_corr_20", "vol_trend")).scalar()
    exportable = F.col("entry_family").isNotNull()
    rank = F.row_number().over(Window.orderBy(F.desc("priority_score"), "symbol", "hypothesis_type"))
    return candidates.select(
        ident.alias("id"), F.lit(as_of).cast("date").alias("date"), rank.cast("bigint").alias("rank"),
        "hypothesis_type", "mechanism_tag", "priority_score",
        F.coalesce("holding_horizon", F.lit("20D")).alias("holding_horizon"),
        F.struct("symbol", "close", "rel_volume", (F.col("gap") * 100).alias("gap_pct"), "close_pos",
                 "rs_rank_pct", "n_hints").alias("observation"),
        F.struct(F.coalesce("entry_family", F.lit("research_only")).alias("entry_family"))
        .alias("signal_definition"),
        F.struct(F.lit("next_open").alias("entry_timing"),
                 F.array(F.lit(5), F.lit(20), F.lit(60)).alias("hold_days"),
                 F.lit(5).alias("slippage_bps")).alias("test_spec"),
        market.alias("market_context"), (~exportable).alias("research_only"))
