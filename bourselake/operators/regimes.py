"""Market regime scores. Time series have one row per calendar date (or month), so the ordered
windows here are bounded by the calendar; everything above them is an expression on one row."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import avg_full, bands, clamp, interp, running, yes
from bourselake.operators.recurrence import ema
from bourselake.operators.universe import classify


def whole(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(c, 0)


def _at(c: str, n: int, part=()) -> Column:
    return F.lag(c, n).over(Window.partitionBy(*part).orderBy("date"))


# -- breadth health ------------------------------------------------------------------------------
# Score bands.
LEVEL = ((0.70, 95.0), (0.60, 80.0), (0.50, 65.0), (0.40, 50.0), (0.30, 35.0), (0.20, 20.0))
GAP = ((0.15, 95.0), (0.10, 80.0), (0.05, 65.0), (0.0, 50.0), (-0.05, 35.0), (-0.10, 20.0))
PERCENTILE = ((80.0, 90.0), (60.0, 70.0), (40.0, 50.0), (20.0, 30.0))
# days since the marker -> score while rising, while falling
CYCLE = {"TROUGH": ((20, 85.0, 30.0), (60, 75.0, 35.0), (None, 65.0, 40.0)),
         "PEAK": ((20, 60.0, 20.0), (60, 45.0, 15.0), (None, 50.0, 10.0))}
BREADTH_WEIGHTS = {"level": 0.25, "crossover": 0.20, "cycle": 0.20, "bearish": 0.15,
                   "percentile": 0.10, "divergence": 0.10}
HEALTH_ZONES = ((80.0, "Strong"), (60.0, "Healthy"), (40.0, "Neutral"), (20.0, "Weakening"))


def breadth_detail(daily: DataFrame, index: DataFrame) -> DataFrame:
    """Short and long means of breadth with trend, warning and turning-point markers."""
    df = daily.select("date", F.col("pct_above_200").alias("breadth_raw")).join(
        index.select("date", F.col("close").alias("index_price")), "date")
    df = (df.withColumn("ma8", avg_full("breadth_raw", 8, part=[], order="date"))
          .withColumn("ma200", avg_full("breadth_raw", 200, part=[], order="date")))
    df = df.withColumn("ma8", F.floor(F.col("ma8") * 1e6 + 0.50001) / 1e6).withColumn(
        "ma200", F.floor(F.col("ma200") * 1e6 + 0.50001) / 1e6).filter("ma200 IS NOT NULL")
    one, two = _at("ma8", 1), _at("ma8", 2)
    df = df.withColumn("trend", F.when(F.col("ma200") > _at("ma200", 1), 1).otherwise(-1))
    top = yes((one > two) & (one >= F.col("ma8")) & (one >= 0.6))
    low = yes((one < two) & (one <= F.col("ma8")))
    return (df.withColumn("bearish", (F.col("trend") == -1) & (F.col("ma8") < F.col("ma200"))
                          & (F.col("ma8") < 0.5))
            .withColumn("is_peak", top).withColumn("is_trough", low & yes(one <= 0.5))
            .withColumn("is_low", low & yes(one < 0.4)))


def latest_marker(detail: DataFrame, look_back: int = 120) -> DataFrame:
    """Most recent peak or trough within the look-back and the rows since."""
    df = detail.withColumn("k", F.row_number().over(Window.orderBy("date")))
    kind = F.when(F.col("is_peak"), "PEAK").when(F.col("is_trough") | F.col("is_low"), "TROUGH")
    mark = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), "k", "is_low"))
    df = df.withColumn("_m", F.last(mark, ignorenulls=True).over(running([], "date")))
    since = F.col("k") - F.col("_m.k")
    inside = since < look_back
    return (df.withColumn("marker", F.when(inside, F.col("_m.kind")))
            .withColumn("days_since", F.when(inside, since).cast("double"))
            .withColumn("marker_low", F.when(inside, F.col("_m.is_low"))).drop("_m"))


def pink_run(detail: DataFrame) -> DataFrame:
    """Consecutive rows with a falling long mean above the short one."""
    pink = (F.col("trend") == -1) & (F.col("ma8") < F.col("ma200"))
    df = detail.withColumn("k", F.row_number().over(Window.orderBy("date"))).withColumn("pink", pink)
    broken = F.max(F.when(~F.col("pink"), F.col("k"))).over(running([], "date"))
    return df.withColumn("pink_days", F.col("k") - F.coalesce(broken, F.lit(0)))


def _divergence(price: Column, breadth: Column) -> Column:
    return (F.when((price > 3) & (breadth < -0.05), 10.0).when((price > 1) & (breadth < -0.03), 25.0)
            .when((price < -3) & (breadth > 0.05), 80.0).when((price < -1) & (breadth > 0.03), 65.0)
            .when((F.abs(price) < 0.5) & (F.abs(breadth) < 0.01), 50.0)
            .when((price > 0) & (breadth > 0), 70.0).when((price <= 0) & (breadth <= 0), 30.0).otherwise(50.0))


def divergence(detail: DataFrame) -> DataFrame:
    """Price against breadth over 60 and 20 rows (the look-back counts the current row)."""
    first = {c: F.first(c).over(running([], "date")) for c in ("index_price", "ma8")}
    df = detail
    for n in (60, 20):
        price = (F.col("index_price") / F.coalesce(_at("index_price", n - 1), first["index_price"]) - 1) * 100
        move = F.col("ma8") - F.coalesce(_at("ma8", n - 1), first["ma8"])
        df = df.withColumn(f"p{n}", F.floor(price * 1e6 + 0.50001) / 1e6).withColumn(
            f"b{n}", F.floor(move * 1e6 + 0.50001) / 1e6)
        df = df.withColumn(f"score_{n}", _divergence(F.col(f"p{n}"), F.col(f"b{n}")))
    return df.withColumn("divergence", F.col("score_60") * 0.6 + F.col("score_20") * 0.4).withColumn(
        "early_warning", (F.col("score_20") <= 25) & (F.col("score_60") >= 50))


def breadth_components(detail: DataFrame) -> DataFrame:
    """Five of the six component scores for every date; the percentile needs the whole history."""
    df = divergence(pink_run(latest_marker(detail)))
    ago = _at("ma8", 5)
    df = df.withColumn("_ago", ago)
    up, down = yes(F.col("ma8") > F.col("_ago")), yes(F.col("ma8") < F.col("_ago"))
    ma8 = F.col("ma8")
    modifier = (F.when(down & (ma8 > 0.60), -10.0).when(down & (ma8 < 0.40), 5.0)
                .when(up & (ma8 < 0.60), 5.0).otherwise(0.0))
    level = whole(bands("ma8", LEVEL, 5.0) * 0.70 + F.when(F.col("trend") == 1, 80.0).otherwise(20.0) * 0.30)
    gap = ma8 - F.col("ma200")
    cross = bands(gap, GAP, 5.0) + F.when((gap < 0) & up, 10.0).when((gap > 0) & ~up, -10.0).otherwise(0.0)
    cycle = F.lit(50.0)
    for kind, steps in CYCLE.items():
        by_age = None
        for days, rising, falling in steps:
            value = F.when(up, rising).otherwise(falling)
            if days is None:
                by_age = by_age.otherwise(value)
            else:
                cond = F.col("days_since") <= days
                by_age = F.when(cond, value) if by_age is None else by_age.when(cond, value)
        cycle = F.when(F.col("marker") == kind, by_age).otherwise(cycle)
    cycle = cycle + F.when((F.col("marker") == "TROUGH") & F.col("marker_low"), 10.0).otherwise(0.0)
    warn, rising = F.col("bearish"), F.col("trend") == 1
    bearish = (F.when(~warn & rising, 85.0).when(~warn, 50.0).when(rising, 30.0).otherwise(10.0)
               + F.when(warn & (ma8 > 0.50), 15.0).when(warn & (ma8 < 0.25), -5.0).otherwise(0.0)
               + F.when(F.col("pink") & ~warn, -10.0).otherwise(0.0))
    return (df.withColumn("level", clamp(level + modifier, 0.0, 100.0))
            .withColumn("crossover", clamp(cross, 0.0, 100.0)).withColumn("cycle", clamp(cycle, 0.0, 100.0))
            .withColumn("bearish_score", clamp(bearish, 0.0, 100.0)).drop("_ago"))


def breadth_health(detail: DataFrame) -> DataFrame:
    """Composite of the latest date; a missing component hands its weight to the others."""
    last = detail.agg(F.max("date")).scalar()
    rows = breadth_components(detail).filter(F.col("date") == last)
    now = detail.agg(F.max_by("ma8", "date")).scalar()
    history = detail.withColumn("now", now).agg(
        (F.count_if(F.col("ma8") < F.col("now")) / F.count("*") * 100).alias("pct"),
        F.avg(F.when(F.col("is_peak"), F.col("ma8"))).alias("peak"),
        F.avg(F.when(F.col("is_low"), F.col("ma8"))).alias("trough"))
    packed = history.select(F.struct("pct", "peak", "trough")).scalar()
    df = rows.withColumn("h", packed)
    extreme = F.when(yes(F.col("ma8") >= F.col("h.peak") * 0.95), -10.0).when(
        yes(F.col("ma8") <= F.col("h.trough") * 1.05), 10.0).otherwise(0.0)
    df = df.withColumn("percentile", clamp(bands(F.col("h.pct"), PERCENTILE, 10.0) + extreme, 0.0, 100.0))
    df = df.withColumn("bearish", F.col("bearish_score"))
    present = {k: F.when(F.col("marker").isNotNull(), F.lit(w)).otherwise(0.0) if k == "cycle" else F.lit(w)
               for k, w in BREADTH_WEIGHTS.items()}
    total = sum(present.values(), F.lit(0.0))
    composite = sum((F.col(k) * w for k, w in present.items()), F.lit(0.0)) / total
    return df.withColumn("composite", composite).withColumn("zone", bands("composite", HEALTH_ZONES, "Critical"))


def key_levels(detail: DataFrame) -> DataFrame:
    """Levels to watch: the latest long mean, two fixed ones and the historical extremes."""
    one = detail.agg(F.max_by("ma200", "date").alias("ma200_level"),
                     F.avg(F.when(F.col("is_peak"), F.col("ma8"))).alias("average_peak"),
                     F.avg(F.when(F.col("is_low"), F.col("ma8"))).alias("average_trough"))
    one = one.withColumn("extreme_weakness", F.lit(0.40)).withColumn("healthy_threshold", F.lit(0.60))
    names = ["ma200_level", "extreme_weakness", "healthy_threshold", "average_peak", "average_trough"]
    return one.unpivot([], names, "level", "value").filter("value IS NOT NULL")


def score_trend(history: DataFrame, n: int = 5) -> DataFrame:
    """Change over the last n scores and its direction."""
    k = F.row_number().over(Window.orderBy(F.desc("data_date")))
    last = history.withColumn("k", k).filter(F.col("k") <= n).agg(
        (F.max_by("score", "data_date") - F.min_by("score", "data_date")).alias("delta"))
    return last.withColumn("direction", F.when(F.col("delta") > 2, "improving").when(
        F.col("delta") < -2, "deteriorating").otherwise("stable"))


# -- uptrend health -------------------------------------------------------------------------------
OVERBOUGHT, OVERSOLD = 0.37, 0.097
UPTREND_WEIGHTS = {"market": 0.30, "participation": 0.25, "rotation": 0.15, "momentum": 0.20, "history": 0.10}
PENALTIES = {"late_cycle": -5.0, "high_spread": -3.0, "divergence": -3.0}
ZONES = ((80.0, "Strong Bull"), (70.0, "Bull-Upper"), (60.0, "Bull-Lower"), (40.0, "Neutral"),
         (30.0, "Cautious-Upper"), (20.0, "Cautious-Lower"))
COUNT_STEPS = ((10, 100.0), (8, 80.0), (6, 60.0), (4, 40.0), (2, 20.0))
ACCEL_STEPS = ((0.005, 90.0), (0.001, 75.0), (-0.001, 50.0), (-0.005, 25.0))


def _line(c: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return F.lit(y0) + (c - x0) / (x1 - x0) * (y1 - y0)


def uptrend_series(flags: DataFrame, constituents: DataFrame) -> DataFrame:
    """Per sector and for all names: share in uptrend, its 10-row mean, slope and direction.

    `flags(symbol, date, up)`.
    """
    by_sector = flags.join(constituents, "symbol").groupBy(F.col("sector").alias("worksheet"), "date")
    whole_market = flags.groupBy(F.lit("all").alias("worksheet"), "date")
    counted = [F.count_if("up").alias("count"), F.count("*").alias("total")]
    df = by_sector.agg(*counted).unionByName(whole_market.agg(*counted))
    df = df.withColumn("ratio", F.floor(F.col("count") / F.col("total") * 1e6 + 0.50001) / 1e6)
    df = df.withColumn("ma_10", F.floor(avg_full("ratio", 10, 1, ["worksheet"]) * 1e6 + 0.50001) / 1e6)
    df = df.withColumn("slope", F.floor((F.col("ma_10") - _at("ma_10", 1, ["worksheet"])) * 1e6 + 0.50001) / 1e6)
    return df.withColumn("trend", F.when(F.col("slope") > 0, "up").otherwise("down"))


def sector_summary(series: DataFrame) -> DataFrame:
    """Latest row per sector with its status."""
    last = series.filter("worksheet <> 'all'").groupBy(F.col("worksheet").alias("sector")).agg(
        F.max("date").alias("date"), F.max_by(F.struct("count", "total", "ratio", "ma_10", "slope", "trend"), "date").alias("r"))
    return last.select("sector", "date", "r.*").withColumn("status", F.when(
        F.col("ratio") > OVERBOUGHT, "Overbought").when(F.col("ratio") < OVERSOLD, "Oversold").otherwise("Normal"))


def group_table(summary: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: mean ratio, population deviation, spread, dissenting trends and the flag."""
    df = summary.join(groups, "sector").groupBy("group").agg(
        F.avg("ratio").alias("mean_ratio"), F.stddev_pop("ratio").alias("std_dev"),
        (F.max("ratio") - F.min("ratio")).alias("spread"), F.count("*").alias("n"),
        F.count_if(F.col("trend") == "up").alias("n_up"))
    down = F.col("n") - F.col("n_up")
    dissent = F.when(F.col("n_up") >= down, down).otherwise(F.col("n_up"))
    return df.withColumn("dissenters", dissent).withColumn("flagged", (F.col("n") >= 2) & (
        (F.col("std_dev") > 0.08) | (F.col("spread") > 0.20) | (dissent > 0)))


def group_outliers(summary: DataFrame, groups: DataFrame) -> DataFrame:
    """Members more than 1.5 deviations from their group."""
    table = group_table(summary, groups).select("group", "mean_ratio", "std_dev")
    return summary.join(groups, "sector").join(table, "group").withColumn(
        "deviation", F.col("ratio") - F.col("mean_ratio")).filter(
        (F.col("std_dev") > 0) & (F.abs("deviation") > F.col("std_dev") * 1.5))


def rotation_score(table: DataFrame) -> DataFrame:
    """Cyclical against defensive, with the late-cycle and divergence adjustments."""
    def mean(g: str) -> Column:
        return F.max(F.when(F.col("group") == g, F.col("mean_ratio")))
    one = table.agg(mean("cyclical").alias("cyclical"), mean("defensive").alias("defensive"),
                    mean("commodity").alias("commodity"),
                    F.coalesce(F.max(F.when(F.col("group") != "commodity", F.col("flagged").cast("int"))), F.lit(0)).alias("div"))
    d = F.col("cyclical") - F.col("defensive")
    base = (F.when(d > 0.15, F.least(F.lit(100.0), _line(d, 0.15, 90, 0.25, 100)))
            .when(d > 0.05, _line(d, 0.05, 70, 0.15, 89)).when(d > -0.05, _line(d, -0.05, 45, 0.05, 69))
            .when(d > -0.15, _line(d, -0.15, 20, -0.05, 44)).otherwise(F.greatest(F.lit(0.0), _line(d, -0.25, 0, -0.15, 19))))
    best = F.greatest("cyclical", "defensive")
    late = yes((F.col("commodity") > F.col("cyclical")) & (F.col("commodity") > F.col("defensive")))
    penalty = F.when(late, F.when(F.col("commodity") - best > 0.10, -10.0).otherwise(-5.0)).otherwise(0.0)
    score = whole(clamp(base + penalty + F.when(F.col("div") == 1, -5.0).otherwise(0.0), 0.0, 100.0))
    return (one.withColumn("difference", d).withColumn("late_cycle", late).withColumn("divergence", F.col("div") == 1)
            .withColumn("score", F.coalesce(score, F.lit(50.0))).drop("div"))


def momentum(series: DataFrame) -> DataFrame:
    """Smoothed slope and its acceleration, ten rows against the ten before (five if short)."""
    df = ema(series.filter("slope IS NOT NULL"), "slope", 3, "smoothed", part=("worksheet",))
    w = Window.partitionBy("worksheet").orderBy("date")
    k = F.row_number().over(w)
    for n in (10, 5):
        m = avg_full("smoothed", n, part=["worksheet"])
        df = df.withColumn(f"_m{n}", m).withColumn(f"_a{n}", F.col(f"_m{n}") - F.lag(f"_m{n}", n).over(w))
    accel = F.when(k >= 20, F.col("_a10")).when(k >= 10, F.col("_a5"))
    return df.withColumn("acceleration", accel).drop("_m10", "_a10", "_m5", "_a5")


def slope_score(s: Column) -> Column:
    return (F.when(s >= 0.02, F.least(F.lit(100.0), _line(s, 0.02, 95, 0.03, 100))).when(s >= 0.01, _line(s, 0.01, 75, 0.02, 94))
            .when(s >= 0, _line(s, 0.0, 55, 0.01, 74)).when(s >= -0.01, _line(s, -0.01, 35, 0.0, 54))
            .when(s >= -0.02, _line(s, -0.02, 10, -0.01, 34)).otherwise(F.greatest(F.lit(0.0), _line(s, -0.03, 0, -0.02, 9))))


def ratio_score(r: Column) -> Column:
    return (F.when(r >= 0.50, F.least(F.lit(100.0), _line(r, 0.50, 90, 0.60, 100)))
            .when(r >= OVERBOUGHT, _line(r, OVERBOUGHT, 70, 0.50, 89)).when(r >= 0.25, _line(r, 0.25, 40, OVERBOUGHT, 69))
            .when(r >= OVERSOLD, _line(r, OVERSOLD, 10, 0.25, 39)).otherwise(F.greatest(F.lit(0.0), _line(r, 0.0, 0, OVERSOLD, 9))))


def spread_score(s: Column) -> Column:
    return (F.when(s < 0.15, 100.0).when(s < 0.25, _line(s, 0.15, 100, 0.25, 80)).when(s < 0.35, _line(s, 0.25, 80, 0.35, 60))
            .when(s < 0.45, _line(s, 0.35, 60, 0.45, 30)).otherwise(F.greatest(F.lit(0.0), _line(s, 0.45, 30, 0.55, 0))))


def uptrend_health(series: DataFrame, groups: DataFrame) -> DataFrame:
    """Five components of the latest date, warning penalties, composite and zone."""
    summary = sector_summary(series)
    market = series.filter("worksheet = 'all'")
    now = F.max_by(F.struct("ratio", "trend", "slope"), "date")
    one = market.agg(now.alias("m"))
    part = summary.agg(F.count_if(F.col("trend") == "up").alias("up"), F.count("*").alias("n"),
                       (F.max("ratio") - F.min("ratio")).alias("spread"), F.count_if(F.col("slope") > 0).alias("pos"))
    rot = rotation_score(group_table(summary, groups))
    mom = momentum(series).filter("worksheet = 'all'").agg(F.max_by(F.struct("smoothed", "acceleration"), "date").alias("x"))
    current = market.agg(F.max_by("ratio", "date")).scalar()
    hist = market.withColumn("c", current).agg(((F.count_if(F.col("ratio") < F.col("c"))
                                                 + F.count_if(F.col("ratio") == F.col("c")) * 0.5) / F.count("*") * 100).alias("h"))
    df = (one.withColumn("p", part.select(F.struct("up", "n", "spread", "pos")).scalar())
          .withColumn("r", rot.select(F.struct("score", "late_cycle", "divergence")).scalar())
          .withColumn("x", mom.select("x").scalar()).withColumn("h", hist.select("h").scalar()))
    r, slope = F.col("m.ratio"), F.col("m.slope")
    adjust = F.when((F.col("m.trend") == "up") & (slope > 0), 5.0).when((F.col("m.trend") == "down") & (slope < 0), -5.0).otherwise(0.0)
    accel = F.coalesce(bands(F.col("x.acceleration"), ACCEL_STEPS, 10.0, strict=True), F.lit(50.0))
    cols = {"market": ratio_score(r) + adjust,
            "participation": bands(F.col("p.up"), COUNT_STEPS, 0.0) * 0.60 + spread_score(F.col("p.spread")) * 0.40,
            "rotation": F.col("r.score"),
            "momentum": slope_score(F.col("x.smoothed")) * 0.50 + accel * 0.30 + F.col("p.pos") / F.col("p.n") * 100 * 0.20,
            "history": F.floor(F.col("h") * 10 + 0.50001) / 10}
    for name, c in cols.items():
        df = df.withColumn(name, whole(clamp(c, 0.0, 100.0)))
    flags = {"late_cycle": F.col("r.late_cycle"), "high_spread": F.col("p.spread") > 0.40, "divergence": F.col("r.divergence")}
    penalty = sum((F.when(c, PENALTIES[k]).otherwise(0.0) for k, c in flags.items()), F.lit(0.0))
    fired = sum((F.when(c, 1).otherwise(0) for c in flags.values()), F.lit(0))
    df = df.withColumn("penalty", penalty + F.when(fired >= 2, 1.0).otherwise(0.0))
    raw = sum((F.col(k) * w for k, w in UPTREND_WEIGHTS.items()), F.lit(0.0))
    df = df.withColumn("raw", raw).withColumn("composite", clamp(F.col("raw") + F.col("penalty"), 0.0, 100.0))
    edge = F.least(*[F.abs(F.col("composite") - b) for b in (20.0, 40.0, 60.0, 80.0)])
    return (df.withColumn("zone", bands("composite", ZONES, "Bear")).withColumn("boundary_distance", edge)
            .select(*cols, "penalty", "raw", "composite", "zone", "boundary_distance"))


def uptrend_simple(aggregate: DataFrame, groups: DataFrame, history: DataFrame) -> DataFrame:
    """Five simple components over sector aggregates; history(avg_ratio) needs 20 samples."""
    one = aggregate.join(groups, "sector", "left").agg(
        F.avg("ratio").alias("avg_ratio"), F.avg((F.col("ratio") > 0.5).cast("int")).alias("part"),
        F.coalesce(F.avg(F.when(F.col("group") == "cyclical", F.col("ratio"))), F.lit(0.0)).alias("cyc"),
        F.coalesce(F.avg(F.when(F.col("group") == "defensive", F.col("ratio"))), F.lit(0.0)).alias("dfn"),
        F.avg((F.col("momentum_20d") > 0).cast("int")).alias("mom"))
    avg_now = aggregate.agg(F.avg("ratio")).scalar()
    past = history.withColumn("now", avg_now).agg(F.when(
        F.count("*") >= 20, F.count_if(F.col("avg_ratio") < F.col("now")) / F.count("*") * 100).otherwise(50.0).alias("h"))
    df = one.withColumn("historical", past.select("h").scalar())
    df = (df.withColumn("breadth", F.col("avg_ratio") * 100).withColumn("participation", F.col("part") * 100)
          .withColumn("rotation", clamp(F.lit(50.0) + (F.col("cyc") - F.col("dfn")) * 100, 0.0, 100.0))
          .withColumn("momentum", F.coalesce(F.col("mom") * 100, F.lit(50.0))))
    total = (F.col("breadth") * 0.30 + F.col("participation") * 0.25 + F.col("rotation") * 0.15
             + F.col("momentum") * 0.20 + F.col("historical") * 0.10)
    return df.withColumn("composite", total).withColumn(
        "signal", F.when(F.col("composite") >= 65, "healthy").when(F.col("composite") < 40, "weak").otherwise("mixed"))


def cycle_phase(summary: DataFrame, phases: DataFrame) -> DataFrame:
    """Score of each cycle phase from its expected leaders and laggards; the halves overlap.

    `phases(phase, role, sector)`.
    """
    n = summary.agg(F.count("*")).scalar()
    rank = F.row_number().over(Window.orderBy(F.desc("ratio"), "sector"))
    ranked = summary.withColumn("k", rank).withColumn("n", n)
    half = F.floor(F.col("n") / 2)
    df = phases.join(ranked.withColumn("top", F.col("k") <= half + 1).withColumn("bottom", F.col("k") > half), "sector", "left")
    lead, lag = F.col("role") == "leader", F.col("role") == "laggard"
    agreed = F.when(lead, F.col("trend") == "up").otherwise(F.col("trend") == "down")
    out = df.groupBy("phase").agg(
        F.coalesce(F.avg(F.when(lead, yes(F.col("top")).cast("int"))), F.lit(0.0)).alias("leaders"),
        F.coalesce(F.avg(F.when(lag, yes(F.col("bottom")).cast("int"))), F.lit(0.0)).alias("laggards"),
        F.coalesce(F.avg(F.when(F.col("trend").isNotNull(), agreed.cast("int"))), F.lit(0.0)).alias("trends"))
    return out.withColumn("score", (F.col("leaders") * 0.4 + F.col("laggards") * 0.3 + F.col("trends") * 0.3) * 100)


# -- five-part breadth health ----------------------------------------------------------------------
AD_KNOTS = ((0.0, 0), (0.5, 2), (0.7, 4), (1.0, 8), (1.2, 12), (1.5, 15), (2.0, 19), (2.5, 22), (3.0, 25))
ABOVE_KNOTS = ((0, 0), (25, 5), (35, 9), (45, 13), (55, 17), (65, 21), (75, 25))
HIGHS_KNOTS = ((0.0, 0), (0.5, 4), (1, 8), (2, 12), (3, 16), (5, 20))
SECTOR_KNOTS = ((0.0, 0), (2 / 13, 2), (4 / 13, 5), (6 / 13, 8), (8 / 13, 11), (10 / 13, 14), (11 / 13, 15))
ALIGN = {(1, 1): 15.0, (0, 1): 13.0, (1, 0): 10.0, (0, 0): 8.0, (0, -1): 5.0, (1, -1): 3.0, (-1, -1): 2.0, (-1, 1): 7.0, (-1, 0): 5.0}


def five_part_health(daily: DataFrame, index: DataFrame, sector_share: DataFrame) -> DataFrame:
    """Per date a 100-point score; the advance/decline part gets two points for its trend."""
    df = daily.join(index.select("date", F.col("close").alias("px")), "date").join(sector_share, "date")
    ad = F.coalesce(F.try_divide("advancers", "decliners"), F.lit(3.0))
    hl = F.coalesce(F.try_divide("new_highs", "new_lows"), F.when(F.col("new_highs") > 0, 5.0).otherwise(1.0))
    df = df.withColumn("ad", ad).withColumn("hl", hl)
    a5, a20 = avg_full("ad", 5, 1, [], "date"), avg_full("ad", 20, 1, [], "date")
    df = df.withColumn("_a", F.floor((a5 - a20) * 1e6 + 0.50001) / 1e6)
    part1 = clamp(interp("ad", AD_KNOTS) + F.signum("_a") * 2, 0.0, 25.0)
    price = F.col("px") / _at("px", 20) - 1
    move = F.col("pct_above_200") - _at("pct_above_200", 20)
    df = df.withColumn("_p", F.floor(price * 1e6 + 0.50001) / 1e6).withColumn("_b", F.floor(move * 1e6 + 0.50001) / 1e6)
    up = F.when(F.col("_p") > 0.01, 1).when(F.col("_p") < -0.01, -1).otherwise(0)
    better = F.when(F.col("_b") > 0.02, 1).when(F.col("_b") < -0.02, -1).otherwise(0)
    part5 = F.lit(8.0)
    for (x, y), points in ALIGN.items():
        part5 = F.when((up == x) & (better == y), points).otherwise(part5)
    df = (df.withColumn("ad_score", part1).withColumn("above_score", interp(F.col("pct_above_200") * 100, ABOVE_KNOTS))
          .withColumn("highs_score", interp("hl", HIGHS_KNOTS)).withColumn("sector_score", interp("sector_share", SECTOR_KNOTS))
          .withColumn("align_score", part5))
    total = sum((F.col(c) for c in ("ad_score", "above_score", "highs_score", "sector_score", "align_score")), F.lit(0.0))
    return df.withColumn("score", total).withColumn("zone", bands("score", HEALTH_ZONES, "Critical")).drop("_a", "_p", "_b")


def value_bands(latest: DataFrame, steps8, steps200) -> DataFrame:
    return latest.withColumn("class_8", classify(F.col("ma8") * 100, steps8)).withColumn(
        "class_200", classify(F.col("ma200") * 100, steps200)).withColumn("dead_cross", F.col("ma8") < F.col("ma200"))


# -- exposure and bubble ----------------------------------------------------------------------------
EXPOSURE_WEIGHTS = {"regime": 0.25, "top_risk": 0.20, "breadth": 0.15, "uptrend": 0.15, "institutional": 0.10,
                    "sector": 0.05, "theme": 0.05, "ftd": 0.05}
CRITICAL = ("regime", "top_risk", "breadth")


def exposure_ceiling(inputs: DataFrame) -> DataFrame:
    """Weighted mean of the inputs at hand, haircut for missing critical ones, ceiling and advice."""
    got = {k: F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in EXPOSURE_WEIGHTS.items()}
    weight = sum(got.values(), F.lit(0.0))
    mean = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in got.items()), F.lit(0.0)) / weight
    missing = sum((F.col(k).isNull().cast("int") for k in CRITICAL), F.lit(0))
    score = F.when(weight == 0, 50.0).otherwise(F.greatest(F.lit(0.0), mean - missing * 10))
    df = inputs.withColumn("missing_critical", missing.cast("bigint")).withColumn("composite", F.floor(score * 1e6 + 0.50001) / 1e6)
    c = F.col("composite")
    ceiling = (F.when(c >= 80, F.least(F.lit(100.0), c + 10)).when(c >= 65, F.lit(70) + (c - 65) * 1.3)
               .when(c >= 50, F.lit(50) + (c - 50) * 1.3).when(c >= 35, F.lit(30) + (c - 35) * 1.3)
               .when(c >= 20, F.lit(10) + (c - 20) * 1.3).otherwise(F.greatest(F.lit(0.0), c / 2)))
    risk = F.col("top_risk")
    advice = (F.when((c < 30) | yes(risk < 25), "CASH_PRIORITY")
              .when((c < 50) | yes(risk < 40) | (F.col("missing_critical") >= 2), "REDUCE_ONLY").otherwise("NEW_ENTRY_ALLOWED"))
    broad = yes(F.col("uptrend") >= 50).cast("int") + yes(F.col("breadth") >= 50).cast("int")
    n = sum((F.col(k).isNotNull().cast("int") for k in EXPOSURE_WEIGHTS), F.lit(0))
    sure = F.when((n >= 6) & (F.col("missing_critical") == 0), "HIGH").when(
        (n >= 4) | (F.col("missing_critical") <= 1), "MEDIUM").otherwise("LOW")
    return (df.withColumn("ceiling_pct", F.floor(ceiling + 1e-9).cast("bigint")).withColumn("recommendation", advice)
            .withColumn("participation", F.when(broad == 2, "BROAD").when(broad == 1, "MODERATE").otherwise("NARROW"))
            .withColumn("confidence", sure))


BUBBLE = ("mass_penetration", "media_saturation", "new_accounts", "new_issuance", "leverage", "price_acceleration",
          "valuation_disconnect", "breadth_expansion")


def bubble_score(indicators: DataFrame) -> DataFrame:
    """Eight 0..2 indicators to a phase and a stage of the cycle."""
    total = sum((F.col(c) for c in BUBBLE), F.lit(0))
    df = indicators.withColumn("total", total.cast("bigint"))
    t = F.col("total")
    phase = F.when(t <= 4, "normal").when(t <= 8, "caution").when(t <= 12, "euphoria").otherwise("critical")
    stage = (F.when(t <= 4, "displacement").when(t <= 8, F.when((F.col("media_saturation") >= 1) & (F.col("price_acceleration") >= 1), "boom").otherwise("displacement"))
             .when(t <= 12, F.when((F.col("mass_penetration") >= 2) & (F.col("media_saturation") >= 2), "euphoria").otherwise("late boom"))
             .otherwise(F.when(F.col("mass_penetration") >= 2, "profit taking").otherwise("euphoria")))
    return df.withColumn("percentage", t / 16 * 100).withColumn("phase", phase).withColumn("stage", stage)


# -- macro regime -------------------------------------------------------------------------------------
MACRO_WEIGHTS = {"concentration": 0.25, "yield_curve": 0.20, "credit_conditions": 0.15, "size_factor": 0.15,
                 "equity_bond": 0.15, "sector_rotation": 0.10}
# Label when the ratio rises, falls, or says nothing.
DIRECTIONS = {"concentration": ("broadening", "concentrating", "unknown"),
              "yield_curve": ("steepening", "flattening", "stable"),
              "credit_conditions": ("easing", "tightening", "stable"),
              "size_factor": ("small_cap_leading", "large_cap_leading", "neutral"),
              "equity_bond": ("risk_on", "risk_off", "neutral"), "sector_rotation": ("risk_on", "risk_off", "neutral")}


def correlation_bonus(six: Column, twelve: Column) -> Column:
    """Points for the equity-bond component when its correlation changes."""
    return F.when(six.isNull() | twelve.isNull(), 0.0).when((six > 0) != (twelve > 0), 20.0).when(
        F.abs(six - twelve) > 0.3, 10.0).otherwise(0.0)


def macro_components(ratios: DataFrame, crossings: DataFrame, bonus: Column | None = None) -> DataFrame:
    """Transition score and direction per component. `ratios(symbol, month, ratio)`, one series each;
    `crossings` is the crossover summary of the same series."""
    w = Window.partitionBy("symbol").orderBy("month")
    df = ratios.withColumn("s6", avg_full("ratio", 6, order="month")).withColumn("s12", avg_full("ratio", 12, order="month"))
    for n in (3, 12):
        past = F.lag("ratio", n).over(w)
        df = df.withColumn(f"roc_{n}m", F.try_divide(F.col("ratio") - past, past) * 100)
    now = df.groupBy("symbol").agg(F.max_by(F.struct("ratio", "s6", "s12", "roc_3m", "roc_12m"), "month").alias("r"),
                                   F.count("*").alias("months"))
    hist = ratios.join(now.select("symbol", F.col("r.ratio").alias("cur")), "symbol").groupBy("symbol").agg(
        (F.count_if(F.col("ratio") < F.col("cur")) / F.count("*") * 100).alias("percentile"))
    df = now.select("symbol", "months", "r.*").join(hist, "symbol").join(crossings, "symbol")
    crossed = F.col("type").isin("golden_cross", "death_cross")
    short, long = F.col("roc_3m"), F.col("roc_12m")
    base = (F.when(crossed, F.when(F.col("bars_ago") <= 2, 40).when(F.col("bars_ago") <= 5, 30).otherwise(20))
            .when(F.col("type") == "converging", F.floor(F.greatest(F.lit(0.0), F.lit(1.0) - F.abs("gap_pct")) * 25)).otherwise(0))
    bounce = F.floor(F.least(F.abs(short), F.lit(5.0)) / 5.0 * 30)
    shift = F.when(short.isNull() | long.isNull(), 0).when(((long < 0) & (short > 0)) | ((long > 0) & (short < 0)), bounce).when(
        F.abs(short) > 3, 10).otherwise(0)
    agree = (crossed.cast("int") + yes(((F.col("type") == "golden_cross") & (short > 0)) | ((F.col("type") == "death_cross") & (short < 0))).cast("int")
             + yes(F.abs(F.col("s6") - F.col("s12")) / F.col("s12") * 100 > 0.5).cast("int"))
    extra = F.when(F.col("symbol") == "equity_bond", F.lit(0.0) if bonus is None else bonus).otherwise(0.0)
    df = df.withColumn("score", clamp(clamp((base + shift + agree * 10).cast("double"), 0.0, 100.0) + extra, 0.0, 100.0))
    labels = F.create_map(*[x for k, v in DIRECTIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    mine = F.element_at(labels, F.col("symbol"))
    cross = F.when(F.col("type") == "golden_cross", 1).when(F.col("type") == "death_cross", -1)
    move = F.when(short > 0, 1).when(short < 0, -1)
    stale = yes(F.col("bars_ago") >= 3)
    fallback = F.when(F.col("symbol") == "concentration", F.when(F.col("s6") > F.col("s12"), 1).otherwise(-1)).otherwise(move)
    way = F.when(cross.isNotNull(), F.when(stale & yes(move != cross), move).otherwise(cross)).otherwise(fallback)
    label = F.when(way == 1, mine[0]).when(way == -1, mine[1]).otherwise(mine[2])
    qualifier = F.when(cross.isNull() | move.isNull(), "N/A").when(move == cross, "confirmed").when(stale, "reversing").otherwise("fading")
    return df.withColumn("direction", label).withColumn("qualifier", qualifier).withColumn("available", F.col("months") >= 12)


def correlation_regime(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c < -0.3, "negative_strong").when(c < 0, "negative_mild").when(c < 0.3, "near_zero").otherwise("positive")


def macro_regime(components: DataFrame, correlation: Column) -> DataFrame:
    """One row: four rule scores, transitional tiebreak, capped confidence, transition probability."""
    def direction(k: str) -> Column:
        return F.coalesce(F.max(F.when((F.col("symbol") == k) & F.col("available"), F.col("direction"))), F.lit("unknown"))
    weight = F.create_map(*[x for k, v in MACRO_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    one = components.agg(*[direction(k).alias(k) for k in MACRO_WEIGHTS],
                         F.count_if("available").alias("n_available"), F.count_if(F.col("score") >= 40).alias("signaling"),
                         F.sum(F.col("score") * F.element_at(weight, F.col("symbol"))).alias("composite"),
                         (F.sum("score") / len(MACRO_WEIGHTS)).alias("avg_score")).withColumn("corr_regime", correlation_regime(correlation))

    def p(k: str, points: int, *labels: str) -> Column:
        return F.when(F.col(k).isin(*labels), points).otherwise(0)
    credit = p("credit_conditions", 1, "stable", "easing")
    rules = {
        "concentration_score": p("concentration", 2, "concentrating") + p("size_factor", 2, "large_cap_leading") + credit,
        "broadening_score": p("concentration", 2, "broadening") + p("size_factor", 2, "small_cap_leading") + credit
        + p("sector_rotation", 1, "risk_on") + p("yield_curve", 1, "steepening"),
        "contraction_score": F.greatest(F.lit(0), p("credit_conditions", 2, "tightening") + p("sector_rotation", 2, "risk_off")
                                        + p("equity_bond", 1, "risk_off") + p("yield_curve", 1, "flattening") - p("size_factor", 1, "small_cap_leading")),
        "inflationary_score": p("corr_regime", 3, "positive") + p("corr_regime", 1, "near_zero") + p("equity_bond", 1, "risk_off")}
    df = one.withColumns({k: v.cast("bigint") for k, v in rules.items()})
    entries = F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k.removesuffix("_score")).alias("name")) for i, k in enumerate(rules)])
    df = df.withColumn("_o", F.array_sort(entries))
    best, second = -F.col("_o")[0]["s"], -F.col("_o")[1]["s"]
    tied = (best > 0) & (best - second <= 1)
    moved = ~(tied & (F.col("composite") < 50)) & (F.col("signaling") >= 3) & (best < 3)
    regime = F.when((tied & (F.col("composite") < 50)) | moved, "transitional").otherwise(F.col("_o")[0]["name"])
    strength = F.when(moved, F.col("signaling")).otherwise(best)
    level = F.when(strength >= 4, F.when(tied, 2).otherwise(3)).when(strength >= 3, 2).when(strength >= 2, 1).otherwise(0)
    level = F.when(F.col("n_available") <= 3, 0).when(F.col("n_available") <= 4, F.least(level, F.lit(1))).otherwise(level)
    names = F.array(*[F.lit(x) for x in ("very_low", "low", "moderate", "high")])
    n, a = F.col("signaling"), F.col("avg_score")
    probability = F.when((n >= 4) & (a >= 50), "high").when((n >= 3) & (a >= 40), "moderate").when((n >= 2) & (a >= 30), "low").otherwise("minimal")
    return (df.withColumn("regime", regime).withColumn("confidence", F.element_at(names, (level + 1).cast("int")))
            .withColumn("transition_probability", probability).withColumn("ambiguous", (best > 0) & (second >= best - 1)).drop("_o"))


# -- contraction screen -------------------------------------------------------------------------------
VCP_WEIGHTS = {"trend_score": 0.25, "contraction_score": 0.25, "volume_score": 0.20, "pivot_score": 0.15, "rs_score": 0.15}


def vcp_screen(latest: DataFrame, windows: Sequence[int], min_trend: float, t1: tuple[float, float] = (10.0, 40.0),
               ratio: float = 0.75) -> DataFrame:
    """Trend gate, tightening gate, then the five-part composite on the latest bar of each symbol.

    `latest` carries trend_score, depth_*/high_* per window, dry_up_ratio, volume_score, rs_value, rs_score.
    """
    depths = [F.col(f"depth_{n}") for n in windows]
    steps = [b / a for a, b in zip(depths, depths[1:])]
    tight = F.lit(True)
    for s in steps:
        tight = tight & (s <= ratio)
    df = latest.filter((F.col("trend_score") >= min_trend) & depths[0].between(*t1) & tight)
    mean = sum(steps, F.lit(0.0)) / len(steps)
    count = F.lit(85.0 if len(windows) >= 4 else 72.0 if len(windows) == 3 else 57.0)
    quality = (count + F.when(mean < 0.60, 10.0).when(mean < 0.70, 5.0).otherwise(0.0)
               + F.when(depths[-1] < 5, 10.0).when(depths[-1] < 8, 5.0).otherwise(0.0) + F.when(depths[0].between(15, 30), 5.0).otherwise(0.0))
    pivot = F.col(f"high_{windows[-1]}")
    df = df.withColumn("contraction_score", clamp(quality, 0.0, 100.0)).withColumn("pivot", pivot).withColumn(
        "pivot_distance", (pivot - F.col("close")) / pivot * 100)
    d = F.col("pivot_distance")
    df = df.withColumn("pivot_score", F.when(d < 0, 50.0).when(d <= 3, 90.0).when(d <= 5, 75.0).when(d <= 8, 60.0)
                       .when(d <= 12, 45.0).when(d <= 20, 30.0).otherwise(15.0))
    total = sum((F.col(k) * w for k, w in VCP_WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("composite", total).withColumn(
        "quality", bands("composite", ((80.0, "Excellent"), (65.0, "Good"), (50.0, "Fair")), "Poor"))
