"""Assumption checks per group. Groups may hold a third of all rows: everything is a mergeable
aggregate, and exact quantiles are found by narrowing bins instead of sorting a group in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import safe_div
from bourselake.session import sized


def exact_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float], rounds: int = 2, cells: int = 256) -> DataFrame:
    """Linearly interpolated exact quantiles, one column q_0, q_1, .. per probability.

    Every wanted rank has a bracket of values, at first all. A round takes `cells` splitters from the values inside the
    bracket, by a mergeable sketch, and keeps the three cells around the rank: far more than the sketch may err, and about
    the same number of rows whatever the values are. The values of the last brackets alone are put in order, each value
    once with its count. Ranks with the same bracket share its sketch. Brackets are written, so that the planner sees
    their size: rows meet them where they are, instead of being gathered in one task a group.
    """
    x = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("g IS NOT NULL AND v IS NOT NULL")
    sizes = sized(x.groupBy("g").agg(F.count("*").alias("n")))
    ranks = sizes.select("g", F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(probs)])).alias("r"))
    ranks = ranks.select("g", "r.i", "r.at", F.explode(F.array(F.floor("r.at"), F.ceil("r.at"))).alias("k")).distinct()

    def bracketed(wanted: DataFrame) -> DataFrame:
        return sized(wanted.groupBy("g", "lo", "hi").agg(F.array_sort(F.collect_set("k")).alias("ks")))

    brackets = bracketed(ranks.select("g", "k", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")))
    keys = ["g", "ks", "lo", "hi"]
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    grid = [c / cells for c in range(1, cells)]
    for _ in range(rounds):
        seen = x.join(brackets, "g").groupBy(*keys).agg(
            F.count_if(F.col("v") < F.col("lo")).alias("before"), F.count_if(inside).alias("c"),
            F.percentile_approx(F.when(inside, F.col("v")), grid, 40 * cells).alias("s"))
        seen = seen.withColumn("k", F.explode("ks"))
        cell = F.floor((F.col("k") - F.col("before")) * cells / F.col("c")).cast("int")
        brackets = bracketed(seen.select("g", "k", F.greatest("lo", F.coalesce(F.get("s", cell - 2), F.col("lo"))).alias("lo"),
                                         F.least("hi", F.coalesce(F.get("s", cell + 1), F.col("hi"))).alias("hi")))
    # all that lies before a bracket is one row without a value, first in order
    near = x.join(brackets, "g").filter(F.col("v") <= F.col("hi"))
    values = near.groupBy(*keys, F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("top", F.sum("c").over(w)).withColumn("k", F.explode("ks"))
    hit = ranks.join(values.filter((F.col("k") >= F.col("top") - F.col("c")) & (F.col("k") < F.col("top"))).drop("ks", "lo", "hi"), ["g", "k"], "left")
    # a rank outside its bracket would be an error of the sketch: fail rather than answer wrongly
    found = F.when(F.col("v").isNull(), F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(F.col("v"))
    share = F.when(F.col("k") == F.floor("at"), F.lit(1.0) - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
    # a whole rank is one row with weight one
    q = hit.groupBy("g", "i").agg(F.sum(found * share).alias("q"))
    return q.groupBy(F.col("g").alias(group)).agg(*[
        F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q_{i}") for i in range(len(probs))])


def outliers(df: DataFrame, group: str, value: str, fence: float = 1.5, z_limit: float = 3.0) -> DataFrame:
    """Quartile fences and the number of values outside, by the quartile rule and by z."""
    q = exact_quantiles(df, group, value, (0.25, 0.75))
    q = q.withColumn("low", F.col("q_0") - (F.col("q_1") - F.col("q_0")) * fence).withColumn(
        "high", F.col("q_1") + (F.col("q_1") - F.col("q_0")) * fence)
    m = df.groupBy(group).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    both = df.join(sized(q.join(m, group)), group)
    x = F.col(value)
    return both.groupBy(group).agg(
        F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"),
        F.count_if((x < F.col("low")) | (x > F.col("high"))).alias("n_iqr"),
        F.count_if(F.abs(x - F.col("m")) > F.col("s") * z_limit).alias("n_z"))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Homogeneity of variance about the group medians, and the ratio of extreme variances."""
    med = exact_quantiles(df, group, value, (0.5,)).select(group, F.col("q_0").alias("med"))
    z = F.abs(F.col(value) - F.col("med"))
    per = df.join(sized(med), group).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(z).alias("zb"), F.var_pop(z).alias("vz"), F.var_samp(value).alias("v"))
    grand = per.agg((F.sum(F.col("n") * F.col("zb")) / F.sum("n"))).scalar()
    return per.withColumn("g", grand).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("zb") - F.col("g"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("vz")).alias("within"), (F.max("v") / F.min("v")).alias("variance_ratio")).select(
        "k", "n", ((F.col("n") - F.col("k")) / (F.col("k") - 1) * F.col("between") / F.col("within")).alias("statistic"),
        "variance_ratio")


def linearity(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.sqrt((F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x))
                                            / F.count("*")).alias("rmse"))


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Skewness, excess kurtosis and the Jarque-Bera statistic."""
    out = df.groupBy(group).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return out.withColumn("jarque_bera", jb)


def assumption_summary(df: DataFrame, group: str, value: str, x: str) -> DataFrame:
    """One row per check: the worst figure over the groups."""
    normal = moments(df, group, value).agg(F.max("jarque_bera").alias("figure"))
    spread = levene(df, group, value).select(F.col("statistic").alias("figure"))
    line = linearity(df, group, x, value).agg(F.min("r2").alias("figure"))
    out = outliers(df, group, value).agg(F.max(safe_div("n_iqr", "n")).alias("figure"))
    parts = [d.select(F.lit(name).alias("check"), "figure") for name, d in (
        ("normality", normal), ("equal_variance", spread), ("linearity", line), ("outliers", out))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# -- statements ----------------------------------------------------------------------------------
def unpivot_statements(wide: DataFrame, years: Sequence[int]) -> DataFrame:
    return wide.unpivot(["symbol", "line_item"], [f"y{y}" for y in years], "period", "value")


def growth_metrics(long: DataFrame, spans: Sequence[int] = (3,)) -> DataFrame:
    """Year-on-year change and compounded growth over the given spans."""
    w = Window.partitionBy("symbol", "line_item").orderBy("period")
    df = long.withColumn("yoy", F.try_divide("value", F.lag("value").over(w)) - 1)
    for n in spans:
        ratio = F.try_divide("value", F.lag("value", n).over(w))
        df = df.withColumn(f"cagr_{n}y", F.when(ratio > 0, F.pow(ratio, F.lit(1.0 / n)) - 1))
    return df


# -- walk-forward model ---------------------------------------------------------------------------
RANKS = 4096  # rows of one bucket of a hash order, on average


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int, out: str, size: int = RANKS) -> DataFrame:
    """Position 0 .. n-1 of every row in the order of a hash of its keys; the keys must tell the rows apart.

    The order is cut into ranges of the hash, ranked one by one; the ranges before add up to the offset, so that only one
    row per range enters a window without partitions.
    """
    # the high bits of the hash are the range, so ranges follow one another in the order of the hash
    parts = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("double").alias("n")).scalar()
    mixed = F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in keys], F.lit(seed)), 1)
    held = df.withColumn("_h", mixed).withColumn("_range", F.floor(F.col("_h") / F.lit(2.0 ** 63) * parts).cast("long"))
    within = Window.partitionBy("_range").orderBy("_h", *keys)
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("_k", F.row_number().over(within)).join(sizes.select("_range", before.alias("_before")), "_range")
    return held.withColumn(out, F.col("_before") + F.col("_k") - 1).drop("_h", "_range", "_k", "_before")


def shuffled(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seed: int = 42) -> DataFrame:
    """Every row with the `columns` of another row beside its own, as `<name>_other`: one permutation of all rows.

    Two hash orders of the same rows are joined on their positions, so the result depends on the keys and the seed alone, not
    on partitions or row order, and every row gives its values exactly once.
    """
    takers = hash_rank(df, keys, seed, "_at")
    givers = hash_rank(df.select(*keys, *[F.col(c).alias(f"{c}_other") for c in columns]), keys, seed + 1, "_at").drop(*keys)
    return takers.join(givers, "_at").drop("_at")


def area_under_curve(scored: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """AUC per group, ties by half; null where one class is missing. Rows are counted per distinct score first."""
    per = scored.groupBy(group, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("wins", F.col("p") * (below + F.col("q") / 2))
    return per.groupBy(group).agg(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("q")).alias("auc"))


def permutation_importance(model, test: DataFrame, keys: Sequence[str], names: Sequence[str], label: str = "label") -> DataFrame:
    """feature, auc, importance: what the AUC of a fitted model loses when one feature is shuffled over the test rows.

    The model is not fitted again; all features are scored in one pass, `none` is the unchanged table. Rows without a value
    take no part. One distinct score per row at worst enters the window of its feature.
    """
    from pyspark.ml.functions import vector_to_array
    both = shuffled(test.select(*keys, label, *names).dropna(), keys, names)
    cases = [F.struct(F.lit("none").alias("feature"), *[F.col(n).cast("double").alias(n) for n in names])]
    cases += [F.struct(F.lit(f).alias("feature"), *[F.col(f"{n}_other" if n == f else n).cast("double").alias(n) for n in names]) for f in names]
    rows = both.select(label, F.explode(F.array(*cases)).alias("c")).select(label, "c.*")
    scored = model.transform(rows).withColumn("_score", vector_to_array("probability")[1])
    auc = area_under_curve(scored, "feature", label, "_score")
    base = auc.where("feature = 'none'").agg(F.max("auc")).scalar()
    return auc.select("feature", "auc", (base - F.col("auc")).alias("importance"))


def boosted(names: Sequence[str], trees: int):
    """Scaler and boosted trees on the named columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                            GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.1, seed=42)])


def by_date(features: DataFrame, columns: Sequence[str], train_share: float) -> tuple[DataFrame, DataFrame]:
    """Complete rows of the first dates and of the rest."""
    df = features.select(*columns).dropna()
    day = F.unix_date("date")
    last = df.select("date").distinct().agg(F.percentile(day, F.lit(train_share)).cast("int")).scalar()
    return df.filter(day <= last), df.filter(day > last)


def walk_forward_importance(features: DataFrame, names: Sequence[str], label: str = "target", keys: Sequence[str] = ("symbol", "date"),
                            train_share: float = 0.7, trees: int = 10) -> DataFrame:
    """Boosted trees on the first dates; permutation importance of each feature on the last dates."""
    from bourselake.session import cut_lineage
    held = features.withColumn("label", F.col(label).cast("double"))
    train, test = by_date(cut_lineage(held.select(*keys, "label", *names)), [*keys, "label", *names], train_share)
    return permutation_importance(boosted(names, trees).fit(train), test, keys, names)


def walk_forward_ml(features: DataFrame, categories: dict[str, list[str]], label: str = "target",
                    train_share: float = 0.7, trees: int = 10) -> DataFrame:
    """Boosted trees on the first dates, scored on the last; once whole and once without each
    category. The scaler sees training dates only."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    names = [c for group in categories.values() for c in group]
    df = features.select("date", F.col(label).cast("double").alias("label"), *names).dropna()
    day = F.unix_date("date")
    dates = df.select("date").distinct().agg(F.percentile(day, F.lit(train_share)).cast("int")).scalar()
    df = df.withColumn("train", day <= dates).persist()
    train, test = df.filter("train"), df.filter(~F.col("train"))
    score = BinaryClassificationEvaluator(labelCol="label")
    rows = []
    for dropped, kept in [("none", names)] + [(c, [n for n in names if n not in group]) for c, group in categories.items()]:
        stages = [VectorAssembler(inputCols=kept, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                  GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.1, seed=42)]
        rows.append((dropped, len(kept), float(score.evaluate(Pipeline(stages=stages).fit(train).transform(test)))))
    df.unpersist()
    base = rows[0][2]
    return features.sparkSession.createDataFrame(
        [(d, n, a, a - base) for d, n, a in rows], "dropped string, n_features int, auc double, delta double")
