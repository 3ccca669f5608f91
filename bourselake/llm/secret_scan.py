"""Secrets: patterns, and tokens that a Markov model of random strings explains better than one of ordinary words. Native."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import let, no_spans, spans_of, tagged, text_of
from bourselake.llm.pii import sanitised

PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
NEEDED = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{32}"}
#: The value inside an assignment: what follows the sign, blanks and quote.
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
LEAST = {"assign": 8, "access": 16, "hex": 32}
TOKEN = r"(?<![\p{L}\p{M}\p{N}+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![\p{L}\p{M}\p{N}])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIDE = len(ALPHABET) + 1


def own(kind: str) -> Column:
    return F.col(f"_{kind}")


def value_of(kind: str, match: Column) -> Column:
    return F.regexp_extract(match, VALUE, 1) if kind == "assign" else match


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(spans_of(text, PATTERNS[kind]), lambda s: F.length(value_of(kind, s["value"])) >= LEAST[kind])
    return F.when(text.rlike(NEEDED[kind]), found).otherwise(no_spans())


def steps_of(token: Column) -> Column:
    """Cells of the transition table: previous and present character, 0 before the first and for others."""
    chars = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(chars, lambda all: F.transform(F.slice(all, F.lit(1), F.greatest(F.size(all) - 1, F.lit(0))),
                                              lambda c, i: c * SIDE + F.get(all, i + 1)))


def with_base(docs: DataFrame) -> DataFrame:
    text = docs.drop("_text", "_tokens", "_random", *[f"_{kind}" for kind in PATTERNS]).select("*", text_of("text").alias("_text"))
    return text.select("*", *[base_spans(F.col("_text"), kind).alias(f"_{kind}") for kind in PATTERNS],
                       F.when(F.col("_text").rlike("[A-Za-z0-9+/_=-]{20}"), spans_of(F.col("_text"), TOKEN)).otherwise(no_spans()).alias("_tokens"))


def within(span: Column, spans: Column) -> Column:
    """Whether a span meets one of the others."""
    return F.exists(spans, lambda s: (s["start"] < span["end"]) & (span["start"] < s["end"]))


def ratios(found: DataFrame, random_rows: int) -> Column:
    """Log-likelihood ratio per transition, random over ordinary, as an array of fixed size.

    Random samples: the secret values that the patterns find in the corpus, and `random_rows` labelled strings in hex and
    base64 made by hashing. Ordinary samples: the other long tokens of the corpus that do not mix letters and digits.
    """
    spark = found.sparkSession
    made = spark.range(random_rows).select(F.sha2(F.col("id").cast("string"), 256).alias("hex")).select(F.explode(F.array(
        F.substr("hex", F.lit(1), F.lit(40)), F.base64(F.unhex("hex")), F.translate(F.base64(F.unhex("hex")), "+/=", "-_"))).alias("token"))
    known = found.select(F.explode(tagged(PATTERNS, own, lambda kind, n, s: value_of(kind, s["value"]))).alias("token"))
    apart = F.concat(*[F.col(f"_{k}") for k in PATTERNS])
    plain = found.select(F.explode(F.filter("_tokens", lambda t: ~within(t, apart))).alias("t")).select("t.value")
    plain = plain.where(~(F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]")))
    rows = made.unionByName(known).withColumn("random", F.lit(1)).unionByName(
        plain.select(F.col("value").alias("token"), F.lit(0).alias("random")))
    rows = rows.groupBy("token", "random").agg(F.lit(1).alias("n"))  # copies of a string are one sample
    cells = rows.select("random", F.explode(steps_of(F.col("token"))).alias("cell")).groupBy("cell").agg(
        F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    counts = {r["cell"]: (r["r"], r["o"]) for r in cells.collect()}  # SIDE * SIDE rows at most
    return F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in log_ratios(counts)) + "]"), "array<double>")


def log_ratios(counts: dict[int, tuple[int, int]], hold: float = 8.0) -> list[float]:
    """log p_random / p_ordinary per cell. Each row of a table leans on the frequencies of its characters by `hold` counts."""
    def chances(k: int) -> list[list[float]]:
        table = [[counts.get(b * SIDE + c, (0, 0))[k] for c in range(SIDE)] for b in range(SIDE)]
        total = sum(map(sum, table))
        alone = [(sum(row[c] for row in table) + 0.5) / (total + 0.5 * SIDE) for c in range(SIDE)]
        return [[(n + hold * alone[c]) / (sum(row) + hold) for c, n in enumerate(row)] for row in table]
    random, ordinary = chances(0), chances(1)
    return [math.log(r / o) for rs, os in zip(random, ordinary) for r, o in zip(rs, os)]


def secrets(docs: DataFrame, threshold: float = 0.5, random_rows: int = 4096) -> DataFrame:
    """`docs` with span arrays _assign, _access, _hex, _random (and _text, the text with null as empty).

    `_random` holds the tokens of 20 characters or more, outside the pattern spans, whose log-likelihood ratio per
    transition reaches `threshold`. Whole texts are scanned; repeated rows get equal results; an empty table gives no rows.
    Columns pass through, but for those named like a result or `_tokens`, which the results replace.
    """
    found = with_base(docs)
    ratio = ratios(found, random_rows)
    apart = F.concat(*[F.col(f"_{k}") for k in PATTERNS])
    score = lambda v: let(steps_of(v), lambda c: F.aggregate(c, F.lit(0.0), lambda acc, i: acc + F.get(ratio, i)) / F.size(c))
    odd = F.filter("_tokens", lambda t: ~within(t, apart) & (score(t["value"]) >= threshold))
    return found.withColumn("_random", odd).drop("_tokens")


def span_rows(kinds: tuple[str, ...]) -> Column:
    """All spans as sorted text kind:start:end, by start, then kind in the given order."""
    every = tagged(kinds, own, lambda kind, n, s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), F.concat_ws(
        ":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("t")))
    return F.array_join(F.transform(F.array_sort(every), lambda x: x["t"]), ",")


def masked(found: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """Adds `_clean`: the text with every stretch of meeting spans replaced by `mark`."""
    every = F.array_sort(tagged((*PATTERNS, "random"), own, lambda kind, n, s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def merged(spans: Column) -> Column:
        reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda t: t["end"])), F.lit(-1))
        heads = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), reach(i).alias("before"))), lambda s: s["start"] > s["before"])
        return let(heads, lambda h: F.transform(h, lambda x, i: F.struct(
            x["start"].alias("start"), F.coalesce(F.get(h, i + 1)["before"], reach(F.size(spans))).alias("end"), F.lit(mark).alias("label"))))

    return found.withColumn("_all", let(every, merged)).withColumn("_clean", F.when(
        F.size("_all") > 0, let(F.col("_all"), lambda spans: sanitised(F.col("_text"), spans))).otherwise(F.col("_text"))).drop("_all")
