"""Personal data: pattern spans, and terms that disclose a protected value by corpus co-occurrence. Native throughout."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import let, no_spans, span_text, spans_of, tagged, text_of, written

#: Patterns as given, with possessive repeats and a start that is no continuation, so that long runs take linear time.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"[\p{L}\p{M}]{2,}+"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the Luhn sum."""
    total = F.aggregate(F.split(F.reverse(number), ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")), lambda acc, d: F.struct(
        (acc["i"] + 1).alias("i"),
        (acc["sum"] + F.when(acc["i"] % 2 == 0, d.cast("int")).otherwise(
            (2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int"))).alias("sum")), lambda acc: acc["sum"])
    return total % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    # eight digits or more after leading zeros are over 255 anyway
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^[0-9]{1,3}$") & (
        F.right(p, F.lit(4)).cast("int") <= 255)),
    "card": lambda v: let(digits(v), lambda d: F.length(d).between(13, 19) & luhn(d)),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(spans_of(text, PATTERNS[kind]), lambda s: VALID[kind](s["value"]))
    return F.when(text.rlike(NEEDED[kind]), found).otherwise(no_spans())


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text and one span array per kind."""
    text = docs.select("doc_id", text_of("text").alias("text"))
    return text.select("doc_id", "text", *[base_spans(F.col("text"), kind).alias(kind) for kind in PATTERNS])


def terms_of(text: Column) -> Column:
    """Distinct letter runs in lower case; those inside a mail address are part of the value and do not count."""
    outside = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(TERM), F.lit(0)))


def entities_of() -> Column:
    """What a text protects: the kinds it mentions, groups of values (mail domain, network, issuer, dialling prefix), and values."""
    groups = {"email": lambda v: F.substring_index(v, "@", -1), "ip": lambda v: F.substring_index(v, ".", 2),
              "card": lambda v: F.left(digits(v), F.lit(6)), "phone": lambda v: F.left(digits(v), F.lit(4))}
    def of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.array(F.lit(kind), F.concat(F.lit(f"{kind}-group:"), F.lower(groups[kind](s["value"]))),
                                                          F.concat(F.lit(f"{kind}:"), F.lower(s["value"]))))

    found = [of(kind) for kind in PATTERNS]
    return F.array_distinct(F.flatten(F.concat(*found)))


def disclosing_terms(once: DataFrame, docs: DataFrame, threshold: float, bits: int) -> DataFrame:
    """(text_key, terms): for the texts that protect something, the terms that disclose it.

    All counts are documents of the whole corpus: n, with an entity n_e, with a term n_t, with both n_te. Disclosure is the
    pointwise mutual information, less what chance may add to it, over the information of the entity:
    log(n_te n / (n_t n_e) (1 - 1 / sqrt(d))) / log(n / n_e), where d counts the distinct texts with both. At 1 the term
    stands with the entity only. A pair goes on only if its best value passes, with n_t at least the documents with the term
    among those that protect something; so words of all kinds of text stop before the corpus is counted.
    """
    n = docs.count()
    held = once.select("text_key", "copies", entities_of().alias("entities"), terms_of(F.col("text")).alias("terms"))
    pairs = held.select("copies", F.explode("entities").alias("entity"), "terms").select("copies", "entity", F.explode("terms").alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("d")).where("d > 1")
    known = held.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("d")).where("d > 1")
    least = held.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("n_p"))

    def discloses(n_t: str) -> Column:
        chance = 1 - 1 / F.sqrt("d")
        whole = F.log(F.lit(float(n)) / F.col("n_e"))
        return (F.col("n_e") < n) & (F.log(F.col("n_te") * F.lit(float(n)) / (F.col(n_t) * F.col("n_e")) * chance) >= threshold * whole)

    hopeful = together.join(known.drop("d"), "entity").where(discloses("n_te")).join(least, "term").where(discloses("n_p")).drop("n_p")
    hopeful = written(hopeful)
    maybe = among(hopeful, bits)
    if maybe is None:
        return once.select("text_key", F.array().cast("array<string>").alias("terms")).where("false")
    counted = docs.select(F.explode(F.filter(terms_of(text_of("text")), maybe)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    told = written(hopeful.join(counted, "term").where(discloses("n_t")).select("entity", "term"))
    chosen = among(told, bits)
    if chosen is None:
        return once.select("text_key", F.array().cast("array<string>").alias("terms")).where("false")
    near = held.select("text_key", "entities", F.explode(F.filter("terms", chosen)).alias("term")).select("text_key", "term", F.explode("entities").alias("entity"))
    return near.join(told, ["entity", "term"]).groupBy("text_key").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def among(rows: DataFrame, bits: int):
    """Column function: whether a term may be one of the rows, by a bit per hash in a table of fixed size; None without rows."""
    h = F.pmod(F.xxhash64("term"), F.lit(bits))
    flags = {r["w"]: r["b"] for r in rows.select(F.floor(h / 64).cast("int").alias("w"), (h % 64).cast("int").alias("b")).groupBy("w").agg(
        F.bit_or(F.expr("shiftleft(1L, b)")).alias("b")).collect()}
    if not flags:
        return None
    table = F.from_json(F.lit("[" + ",".join(str(flags.get(i, 0)) for i in range(bits // 64)) + "]"), "array<bigint>")

    def maybe(t: Column) -> Column:
        return let(F.pmod(F.xxhash64(t), F.lit(bits)), lambda x: F.getbit(F.get(table, F.floor(x / 64).cast("int")), (x % 64).cast("int")) == 1)
    return maybe


def personal_data(docs: DataFrame, threshold: float = 0.8, bits: int = 1 << 20) -> DataFrame:
    """doc_id, text, and span arrays email, ip, card, phone, term for every row of `docs` (doc_id, text).

    Base spans follow the patterns on whole texts; `term` spans mark every occurrence, outside mail addresses, of a term that
    discloses something the same text protects: a kind of value, a group of values or a value. Texts without any base span
    meet no join. Repeated rows get equal results (and count as documents, though one text is no evidence twice), null texts
    are empty, an empty table gives no rows, very long texts are read whole, other columns are not read.
    """
    base = with_base(docs)
    hit = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    some = written(base.where(hit).withColumn("text_key", F.sha2("text", 256)))
    once = written(some.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.any_value(F.struct("text", *PATTERNS)).alias("r")).select("text_key", "copies", "r.*"))
    terms = disclosing_terms(once, docs, threshold, bits)
    words = F.filter(spans_of(F.col("text"), TERM), lambda s: F.array_contains("terms", F.lower(s["value"])) & ~F.exists(
        "email", lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"])))
    marked = some.join(terms, "text_key", "left").withColumn("term", F.when(F.col("terms").isNull(), no_spans()).otherwise(words))
    return base.where(~hit).withColumn("term", no_spans()).unionByName(marked.select("doc_id", "text", *PATTERNS, "term"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, label), sorted and disjoint, replaced by its label; an empty label removes it."""
    pieces = F.transform(spans, lambda s, i: F.concat(
        F.substr(text, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))), s["label"]))
    rest = F.coalesce(F.element_at(F.transform(spans, lambda s: s["end"]), -1), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substr(text, rest + 1, F.length(text))))


def with_sanitised(found: DataFrame) -> DataFrame:
    """Adds `clean`: base values generalised to their kind, disclosing terms removed. Of overlapping spans the first stays."""
    every = F.array_sort(tagged((*PATTERNS, "term"), F.col, lambda kind, n, s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit("" if kind == "term" else f"<{kind.upper()}>").alias("label"))))
    apart = let(every, lambda spans: F.filter(F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"),
        F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda t: t["end"])), F.lit(0)).alias("before"))),
        lambda s: s["start"] >= s["before"]))
    return found.withColumn("apart", apart).withColumn("clean", sanitised(F.col("text"), F.col("apart"))).drop("apart")


def all_spans(kinds) -> Column:
    return F.array_join(F.concat(*[span_text(kind, F.col(kind)) for kind in kinds]), ",")
