"""Quality rules: hashed n-gram likelihood ratio of a trusted target against the raw corpus, native throughout."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.llm.common import BLANK, let, text_of, words_of, written

SYMBOLS = "#*$%&|<>"


def ngram_buckets(words: Column, n_buckets: int) -> Column:
    """Hash buckets of the words and of the word pairs of a text, case kept."""
    bucket = lambda *w: F.pmod(F.xxhash64(*w), F.lit(n_buckets)).cast("int")
    first = lambda all: F.slice(all, F.lit(1), F.greatest(F.size(all) - 1, F.lit(0)))
    return let(words, lambda all: F.concat(F.transform(all, lambda w: bucket(w)), F.transform(
        first(all), lambda w, i: bucket(w, F.get(all, i + 1)))))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Windows meet as 64-bit hashes, sorted with their positions; only texts with a repeated window sort. Each repeated
    window adds the words up to the next one, three at most.
    """
    first = lambda all: F.slice(all, F.lit(1), F.greatest(F.size(all) - 2, F.lit(0)))
    hashed = let(words, lambda all: F.transform(first(all), lambda w, i: F.xxhash64(w, F.get(all, i + 1), F.get(all, i + 2))))

    def repeats(placed: Column) -> Column:
        same = lambda x, i: (F.get(placed, i)["h"] == x["h"])
        twice = F.filter(placed, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda a, i: F.least(F.coalesce(F.get(at, i + 1) - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(placed, repeats), covered)).otherwise(0)

    return let(hashed, counted).cast("long")


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words and the counts of the base rules, one row per row."""
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    text = text.withColumn("words", words_of(F.col("text")))
    full = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{BLANK}]"))
    lines = F.when(F.instr("text", "\n") > 0, let(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)
    cut = text.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"))
    return cut.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bucket_ratios(docs: DataFrame, labels: DataFrame, n_buckets: int, target_rows: int) -> DataFrame:
    """log p_target / p_raw per hash bucket, smoothed, every bucket present.

    The raw counts cover all rows. The trusted target is a bounded sample: the `target_rows` labelled ids of quality 1
    with the smallest hashes, so the table that meets the documents has a fixed size.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("trusted", F.lit(1))
    known = docs.select("doc_id", words_of(text_of("text")).alias("words")).select(
        "doc_id", ngram_buckets(F.col("words"), n_buckets).alias("buckets"))
    known = known.join(F.broadcast(trusted), "doc_id", "left").select("trusted", F.explode("buckets").alias("bucket"))
    seen = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"),
                                                      F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    counts = written(seen.unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    share = lambda name: (F.col(name) + 1.0) / (total.select(name).scalar() + n_buckets)
    return counts.select("bucket", F.log(share("target") / share("raw")).alias("ratio"))


def cut_point(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the cut on the score, in hundredths, that parts quality 1 from 0 best; keeping good rows counts twice.

    Ties go to the lowest cut. Null without labels of both kinds: then every score passes.
    """
    marked = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bins = scored.where("not base_failed").join(marked, "doc_id").groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    gain = bins.select("bin", (F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.sum("bad").over(whole)
                               - 2 * F.coalesce(F.sum("good").over(below), F.lit(0)) / F.sum("good").over(whole)).alias("gain"))
    return gain.where("gain is not null").agg(F.min_by(F.col("bin") / 100, F.struct(-F.col("gain"), F.col("bin"))).alias("cut"))


def quality_rules(docs: DataFrame, labels: DataFrame, n_buckets: int = 65536, target_rows: int = 20000) -> DataFrame:
    """Base rules and the likelihood ratio verdict for every row of `docs` (doc_id, text).

    The score is the mean of log p_target / p_raw over the words and word pairs of the whole text (none: 0), both
    multinomials over `n_buckets` hashes. `kept` is false where a base rule fails, else whether the score reaches the cut
    fitted on `labels` (doc_id, quality). Null text has no words; repeated rows are scored one by one; other columns are
    not read.
    """
    docs = docs.select("doc_id", "text")
    ratios = bucket_ratios(docs, labels, n_buckets, target_rows)
    model = [0.0] * n_buckets  # a fixed size, whatever the corpus
    for row in ratios.collect():
        model[row["bucket"]] = row["ratio"]
    ratio = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in model) + "]"), "array<double>")
    base = base_rules(docs).withColumn("buckets", ngram_buckets(F.col("words"), n_buckets))
    total = F.aggregate("buckets", F.lit(0.0), lambda acc, b: acc + F.get(ratio, b))
    scored = written(base.withColumn("score", F.coalesce(F.try_divide(total, F.size("buckets")), F.lit(0.0))
                                     ).drop("words", "buckets"))
    cut = cut_point(scored, labels.select("doc_id", "quality")).select("cut").scalar()
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= cut, F.lit(True)))
