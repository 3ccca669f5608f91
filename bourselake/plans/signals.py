"""Signal aggregation, one batch per signal date, over all events."""
from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.functions import r4, r6
from bourselake.operators import signals as sg
from bourselake.plans.registry import query
from bourselake.plans.views import add_view
from bourselake.session import cut_lineage
from bourselake.sources.market import Market

AS_OF = "2024-01-31"
SOURCES = {"view": "edge_candidate_agent", "click": "edge_concept_synthesizer", "signup": "theme_detector",
           "error": "sector_analyst", "purchase": "institutional_flow_tracker"}


def sources(m: Market):
    """Five event sources and one news source, each in its own shape."""
    s = m.signals.withColumn("batch", F.col("signal_date"))
    text = F.concat_ws(" ", "skill", "direction", F.lit("setup"), F.lit("in"), "ticker")
    hz = F.element_at(F.array(*[F.lit(x) for x in ("20D", "16W", "9M", "1-3 months")]), (F.col("signal_ref") % 4 + 1).cast("int"))
    base = s.withColumn("text", text).withColumn("hz", hz).withColumn("ref", F.col("signal_ref").cast("string"))

    def kind(k):
        return base.filter(F.col("skill") == k).drop("skill", "signal_ref", "title")
    d = F.col("direction")
    view = kind("view").select("batch", F.col("ref").alias("ticket_id"), F.col("text").alias("description"),
                               (F.col("raw_score") * 100).alias("priority_score"), F.array("ticker").alias("symbols"),
                               F.when(d == "LONG", "bullish").when(d == "SHORT", "bearish").otherwise("flat").alias("direction"),
                               F.col("hz").alias("holding_horizon"), F.col("ts").alias("as_of"))
    click = kind("click").select("batch", F.col("ref").alias("concept_id"), F.col("text").alias("title"), F.col("raw_score").alias("confidence"),
                                 F.concat(F.lit(" "), F.lower("ticker")).alias("tickers"), F.lower("direction").alias("stance"), "hz", "ts")
    signup = kind("signup").select("batch", F.col("ref").alias("theme"), F.col("text").alias("name"), F.when(F.col("raw_score") >= 0.5, "A").when(F.col("raw_score") >= 0.2, "C").otherwise("F").alias("heat"),
                                   F.array("ticker", "ticker").alias("tickers"), F.when(d == "LONG", "Up").when(d == "SHORT", "Down").alias("trend"), "hz", "ts")
    error = kind("error").select("batch", F.col("ref").alias("id"), F.col("text").alias("title"), F.col("raw_score").alias("score"), F.col("ticker").alias("symbols"),
                                 F.when(d == "LONG", "increase").when(d == "SHORT", "decrease").alias("view"), "hz", F.col("ts").alias("timestamp"))
    buy = kind("purchase").select("batch", F.col("ref").alias("id"), F.col("text").alias("title"), F.col("raw_score").alias("conviction"), F.array("ticker").alias("tickers"),
                                  F.when(d == "LONG", "accumulation").when(d == "SHORT", "distribution").alias("flow"), "hz", "ts")
    hints = m.news.select(F.col("published").alias("batch"), F.concat(F.lit("n"), F.col("news_id")).alias("id"), F.concat_ws(" ", F.lit("news on"), "symbol").alias("title"),
                          F.col("symbol").alias("symbols"), F.when(F.col("lang") == "en", "buy").otherwise("sell").alias("direction"))
    e = sg.extract
    return (e(view, "edge_candidate_agent", {"signal_ref": ["ticket_id", "id"], "title": ["title", "description"], "raw_score": ["priority_score", "score"], "tickers": ["symbols"],
                                             "direction": ["direction"], "time_horizon": ["time_horizon", "holding_horizon"], "ts": ["timestamp", "as_of"]}),
            e(click, "edge_concept_synthesizer", {"signal_ref": ["concept_id"], "title": ["title"], "raw_score": ["confidence"], "tickers": ["tickers"], "direction": ["stance"], "time_horizon": ["hz"], "ts": ["ts"]}),
            e(signup, "theme_detector", {"signal_ref": ["theme"], "title": ["name"], "raw_score": ["heat"], "tickers": ["tickers"], "direction": ["trend"], "time_horizon": ["hz"], "ts": ["ts"]}),
            e(error, "sector_analyst", {"signal_ref": ["id"], "title": ["title"], "raw_score": ["score"], "tickers": ["symbols"], "direction": ["view"], "time_horizon": ["hz"], "ts": ["timestamp"]}),
            e(buy, "institutional_flow_tracker", {"signal_ref": ["id"], "title": ["title"], "raw_score": ["conviction"], "tickers": ["tickers"], "direction": ["flow"], "time_horizon": ["hz"], "ts": ["ts"]}),
            e(hints.withColumn("s", F.lit(0.5)), "edge_hint_extractor", {"signal_ref": ["id"], "title": ["title"], "raw_score": ["s"], "tickers": ["symbols"], "direction": ["direction"]}))


def canonical(m: Market):
    return sg.union(*sources(m))


SKILL_CASE = "CASE skill " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCES.items()) + " END"
add_view("canon", "signals news", f"""
SELECT signal_date AS batch, {SKILL_CASE} AS skill, CAST(signal_ref AS VARCHAR) AS signal_ref, CONCAT_WS(' ', skill, direction, 'setup', 'in', ticker) AS title,
  CASE WHEN skill = 'view' THEN CASE WHEN raw_score * 100 > 1 THEN raw_score * 100 / 100 ELSE raw_score * 100 END
    WHEN skill = 'signup' THEN CASE WHEN raw_score >= 0.5 THEN 1.0 WHEN raw_score >= 0.2 THEN 0.6 ELSE 0.2 END ELSE raw_score END AS raw_score,
  UPPER(ticker) AS tickers, direction, CASE signal_ref % 4 WHEN 0 THEN '20D' WHEN 1 THEN '16W' WHEN 2 THEN '9M' ELSE '1-3 months' END AS time_horizon, ts FROM signals
UNION ALL SELECT published, 'edge_hint_extractor', CONCAT('n', news_id), CONCAT_WS(' ', 'news on', symbol), 0.5, UPPER(symbol), CASE WHEN lang = 'en' THEN 'LONG' ELSE 'SHORT' END, 'unknown', NULL FROM news""")


@query("signal_extract", "canon", "SELECT skill, signal_ref, title, R4(raw_score) AS raw_score, tickers, direction, time_horizon, ts FROM canon")
def q_extract(m):
    return canonical(m).select("skill", "signal_ref", "title", r4("raw_score").alias("raw_score"),
                               F.array_join("tickers", ",").alias("tickers"), "direction", "time_horizon", "ts")


@query("union_signals", "canon", "SELECT batch, skill, direction, COUNT(*) AS n, R4(AVG(raw_score)) AS mean_score FROM canon GROUP BY 1, 2, 3")
def q_union(m):
    return canonical(m).groupBy("batch", "skill", "direction").agg(F.count("*").alias("n"), r4(F.avg("raw_score")).alias("mean_score"))


@query("horizon_bucket", "canon", """SELECT time_horizon, CASE time_horizon WHEN '20D' THEN 'short' WHEN '16W' THEN 'medium' WHEN '9M' THEN 'long' WHEN '1-3 months' THEN 'short' ELSE 'unknown' END AS bucket,
  COUNT(*) AS n FROM canon GROUP BY 1, 2""")
def q_horizon(m):
    df = canonical(m).withColumn("bucket", sg.horizon(F.col("time_horizon")))
    return df.groupBy("time_horizon", "bucket").agg(F.count("*").alias("n"))


add_view("sigs", "canon", "SELECT batch, direction, tickers, title, COUNT(*) AS n, LIST_DISTINCT(STRING_SPLIT(LOWER(title), ' ')) AS w FROM canon GROUP BY 1, 2, 3, 4")


@query("similar_signal_join", "sigs", """
WITH m AS (SELECT a.batch, a.direction, a.tickers AS tickers_a, a.title AS title_a, b.tickers AS tickers_b, b.title AS title_b, a.n AS n_a, b.n AS n_b,
  a.title = b.title AND a.tickers IS NOT DISTINCT FROM b.tickers AS own, CASE WHEN a.tickers = b.tickers THEN 1.0 ELSE 0.0 END AS ts,
  LEN(LIST_INTERSECT(a.w, b.w)) / CAST(LEN(a.w) + LEN(b.w) - LEN(LIST_INTERSECT(a.w, b.w)) AS DOUBLE) AS xs FROM sigs a JOIN sigs b ON a.batch = b.batch AND a.direction = b.direction),
p AS (SELECT *, CASE WHEN own THEN n_a * (n_a - 1) // 2 ELSE n_a * n_b END AS n_pairs FROM m WHERE (title_a, tickers_a) < (title_b, tickers_b) OR (own AND n_a > 1))
SELECT batch, direction, tickers_a, title_a, tickers_b, title_b, R6(ts) AS ticker_sim, R6(xs) AS title_sim, n_pairs FROM p WHERE ts >= 0.3 OR xs >= 0.6""")
def q_similar(m):
    """Similar signature pairs ordered by title and tickers, with the number of signal pairs they stand for.

    A signature stands for all signals of its batch, direction, tickers and title; those pair among themselves in its row
    with itself.
    """
    df = sg.similar_pairs(cut_lineage(sg.signatures(canonical(m))))
    name = [F.struct(F.col(f"title_{x}").alias("title"), F.when(F.size(f"tickers_{x}") > 0, F.array_join(f"tickers_{x}", ",")).alias("tickers")) for x in "ab"]
    df = df.withColumns({"a": F.least(*name), "b": F.greatest(*name)})
    return df.select("batch", "direction", *[F.col(x)[c].alias(f"{c}_{x}") for x in "ab" for c in ("tickers", "title")],
                     r6("ticker_sim").alias("ticker_sim"), r6("title_sim").alias("title_sim"), "n_pairs")


add_view("ordered", "canon", """SELECT *, ROW_NUMBER() OVER (PARTITION BY batch, direction ORDER BY raw_score DESC, skill, signal_ref) AS i,
  STRING_SPLIT(tickers, ',') AS tk, LIST_DISTINCT(STRING_SPLIT(LOWER(title), ' ')) AS wd FROM canon""")
# one step per position: the primaries so far are a list, and the first similar one absorbs
add_view("visits", "ordered", """
SELECT batch, direction, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, tk VARCHAR[], wd VARCHAR[])[]) AS led, CAST(NULL AS BIGINT) AS hit FROM (SELECT DISTINCT batch, direction FROM ordered)
UNION ALL
SELECT batch, direction, i, CASE WHEN hit IS NULL THEN LIST_APPEND(led, STRUCT_PACK(i := i, tk := tk, wd := wd)) ELSE led END, COALESCE(hit, i)
FROM (SELECT o.batch, o.direction, o.i, o.tk, o.wd, v.led, LIST_FILTER(v.led, lambda l:
    10 * LEN(LIST_INTERSECT(l.tk, o.tk)) >= 3 * (LEN(l.tk) + LEN(o.tk) - LEN(LIST_INTERSECT(l.tk, o.tk)))
    OR 10 * LEN(LIST_INTERSECT(l.wd, o.wd)) >= 6 * (LEN(l.wd) + LEN(o.wd) - LEN(LIST_INTERSECT(l.wd, o.wd))))[1].i AS hit
  FROM visits v JOIN ordered o ON o.batch = v.batch AND o.direction = v.direction AND o.i = v.i + 1)""")
add_view("members", "ordered visits", """
SELECT o.*, v.hit AS lead FROM ordered o JOIN visits v ON v.batch = o.batch AND v.direction = o.direction AND v.i = o.i WHERE v.i > 0""")
add_view("merges", "members", """
SELECT m.batch, m.direction, l.skill, l.signal_ref, l.title, l.time_horizon, l.ts, LIST(m.i) AS ranks,
  ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST(m.tickers))), ',') AS tickers,
  STRING_AGG(CONCAT(m.skill, ':', m.signal_ref), ',' ORDER BY m.i) AS contributing,
  COALESCE(STRING_AGG(CASE WHEN m.i <> m.lead THEN CONCAT(m.skill, ':', m.signal_ref) END, ',' ORDER BY m.i), '') AS merged_from
FROM members m JOIN ordered l ON l.batch = m.batch AND l.direction = m.direction AND l.i = m.lead GROUP BY 1, 2, 3, 4, 5, 6, 7""")


def merged(m: Market):
    return sg.merge(sg.dedupe(canonical(m)))


@query("dedupe_signals", "merges", "SELECT batch, direction, skill, signal_ref, title, time_horizon, tickers, contributing, merged_from FROM merges")
def q_dedupe(m):
    names = F.transform("contributing", lambda c: F.concat(c["skill"], F.lit(":"), c["signal_ref"]))
    return merged(m).select("batch", "direction", "skill", "signal_ref", "title", "time_horizon", F.array_join("tickers", ",").alias("tickers"),
                            F.array_join(names, ",").alias("contributing"), F.array_join("merged_from", ",").alias("merged_from"))


BUCKET = "CASE time_horizon WHEN '20D' THEN 'short' WHEN '16W' THEN 'medium' WHEN '9M' THEN 'long' WHEN '1-3 months' THEN 'short' ELSE 'unknown' END"
add_view("contra", "canon", f"""
WITH s AS (SELECT batch, skill, direction, tickers, {BUCKET} AS bucket, signal_ref FROM canon)
SELECT a.batch, a.tickers AS ticker, a.skill AS skill_long, b.skill AS skill_short, a.bucket AS bucket_long, b.bucket AS bucket_short, a.signal_ref AS ref_long, b.signal_ref AS ref_short,
  CASE WHEN a.skill = b.skill THEN 'HIGH' WHEN NOT (a.bucket = 'unknown' OR b.bucket = 'unknown' OR a.bucket = b.bucket) THEN 'LOW' ELSE 'MEDIUM' END AS severity
FROM s a JOIN s b ON a.batch = b.batch AND a.tickers = b.tickers AND a.direction = 'LONG' AND b.direction = 'SHORT'""")
CONTRA_COLS = "batch, ticker, skill_long, skill_short, bucket_long, bucket_short"


@query("contradiction_join", "contra", f"SELECT {CONTRA_COLS}, COUNT(*) AS n_pairs FROM contra GROUP BY ALL")
def q_contra_join(m):
    return sg.contradiction_pairs(canonical(m)).select("batch", "ticker", "skill_long", "skill_short", "bucket_long", "bucket_short", "n_pairs")


@query("contradictions", "contra", f"SELECT {CONTRA_COLS}, severity, COUNT(*) AS n_pairs FROM contra GROUP BY ALL")
def q_contra(m):
    return sg.contradiction_pairs(canonical(m)).select("batch", "ticker", "skill_long", "skill_short", "bucket_long", "bucket_short", "severity", "n_pairs")


WEIGHT_CASE = "CASE skill " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sg.WEIGHTS.items()) + " ELSE 0.1 END"


def age_case(ts):
    age = f"DATE_DIFF('day', CAST({ts} AS DATE), DATE '{AS_OF}')"
    return f"CASE WHEN {ts} IS NULL THEN 0.85 WHEN {age} < 1 THEN 1.0 WHEN {age} < 4 THEN 0.95 WHEN {age} < 8 THEN 0.9 ELSE 0.85 END"


add_view("scored", "merges members", f"""
WITH g AS (SELECT batch, direction, lead, SUM(raw_score * CAST({WEIGHT_CASE} AS DOUBLE)) / SUM(CAST({WEIGHT_CASE} AS DOUBLE)) AS base, COUNT(DISTINCT skill) AS n_skills, COUNT(*) - 1 AS n_merged, AVG(raw_score) AS avg_raw
  FROM members GROUP BY 1, 2, 3),
a AS (SELECT r.batch, r.direction, r.skill, r.signal_ref, r.tickers, r.time_horizon, g.base, g.n_skills, g.n_merged, g.avg_raw,
  CASE WHEN n_skills >= 3 THEN 0.2 WHEN n_skills = 2 THEN 0.1 ELSE 0 END AS agreement, {age_case('r.ts')} AS recency
  FROM merges r JOIN members m ON m.batch = r.batch AND m.direction = r.direction AND m.skill = r.skill AND m.signal_ref = r.signal_ref AND m.i = m.lead
  JOIN g ON g.batch = m.batch AND g.direction = m.direction AND g.lead = m.lead)
SELECT *, LEAST(1, (base + agreement + n_merged * 0.05) * recency) AS composite_score FROM a""")


@query("signal_score", "scored", """SELECT batch, direction, skill, signal_ref, tickers, n_skills, n_merged, R6(composite_score) AS composite_score, R6(agreement / 0.2 * 0.35) AS conf_agreement, R6(avg_raw * 0.4) AS conf_strength,
  R6(recency * 0.25) AS conf_recency FROM scored""")
def q_score(m):
    return sg.score(merged(m), AS_OF).select("batch", "direction", "skill", "signal_ref", F.array_join("tickers", ",").alias("tickers"), "n_skills", "n_merged",
                                             *[r6(c).alias(c) for c in ("composite_score", "conf_agreement", "conf_strength", "conf_recency")])


add_view("single", "canon contra", f"""
WITH l AS (SELECT batch, skill, signal_ref, raw_score, LEAST(1, raw_score * {age_case('ts')}) AS composite_score FROM canon),
m AS (SELECT batch, skill, ref, SUM(md) AS n_medium, MAX(hi) AS any_high FROM (
  SELECT batch, skill_long AS skill, ref_long AS ref, CAST(severity = 'MEDIUM' AS INT) AS md, CAST(severity = 'HIGH' AS INT) AS hi FROM contra
  UNION ALL SELECT batch, skill_short, ref_short, CAST(severity = 'MEDIUM' AS INT), CAST(severity = 'HIGH' AS INT) FROM contra) GROUP BY 1, 2, 3)
SELECT l.*, CAST(COALESCE(m.n_medium, 0) AS BIGINT) AS n_medium, composite_score * POW(0.9, COALESCE(m.n_medium, 0)) AS adjusted_score FROM l LEFT JOIN m ON m.batch = l.batch AND m.skill = l.skill AND m.ref = l.signal_ref WHERE COALESCE(m.any_high, 0) = 0""")


def single(m: Market):
    """Signals scored on their own, adjusted for the contradictions of their batch."""
    df = sg.contradiction_load(canonical(m))
    df = df.withColumn("composite_score", F.least(F.lit(1.0), F.col("raw_score") * sg.recency("ts", AS_OF)))
    return sg.adjusted(df)


@query("contradiction_adjust", "single", "SELECT batch, skill, signal_ref, n_medium, R6(composite_score) AS composite_score, R6(adjusted_score) AS adjusted_score FROM single")
def q_adjust(m):
    return single(m).select("batch", "skill", "signal_ref", F.col("n_medium").cast("bigint"), r6("composite_score").alias("composite_score"), r6("adjusted_score").alias("adjusted_score"))


add_view("opposed", "scored", f"""
WITH s AS (SELECT *, {BUCKET} AS bucket FROM scored),
pairs AS (SELECT DISTINCT a.batch, a.skill AS skill_a, a.signal_ref AS ref_a, b.skill AS skill_b, b.signal_ref AS ref_b,
    CASE WHEN a.skill = b.skill THEN 'HIGH' WHEN NOT (a.bucket = 'unknown' OR b.bucket = 'unknown' OR a.bucket = b.bucket) THEN 'LOW' ELSE 'MEDIUM' END AS severity
  FROM s a JOIN s b ON a.batch = b.batch AND a.direction = 'LONG' AND b.direction = 'SHORT' AND LEN(LIST_INTERSECT(STRING_SPLIT(a.tickers, ','), STRING_SPLIT(b.tickers, ','))) > 0),
m AS (SELECT batch, skill, ref, SUM(CAST(severity = 'MEDIUM' AS INT)) AS n_medium, MAX(CAST(severity = 'HIGH' AS INT)) AS any_high FROM (
  SELECT batch, skill_a AS skill, ref_a AS ref, severity FROM pairs UNION ALL SELECT batch, skill_b, ref_b, severity FROM pairs) GROUP BY 1, 2, 3)
SELECT s.*, R6(composite_score * POW(0.9, COALESCE(m.n_medium, 0))) AS adjusted_score FROM s LEFT JOIN m ON m.batch = s.batch AND m.skill = s.skill AND m.ref = s.signal_ref WHERE COALESCE(m.any_high, 0) = 0""")


@query("signal_rank", "opposed", """SELECT batch, skill, signal_ref, tickers, n_merged, adjusted_score, ROW_NUMBER() OVER (PARTITION BY batch ORDER BY adjusted_score DESC, skill, signal_ref) AS rank
  FROM opposed QUALIFY adjusted_score >= 0.5""")
def q_rank(m):
    """Merged signals by score, less those that others of the batch contradict."""
    scored = cut_lineage(sg.score(merged(m), AS_OF).select("batch", "skill", "signal_ref", "direction", "tickers", "time_horizon", "n_merged", "composite_score"))
    df = sg.adjusted(sg.contradiction_load(scored)).withColumn("adjusted_score", r6("adjusted_score"))
    return sg.ranked(df, "adjusted_score", 0.5, "skill", "signal_ref").select("batch", "skill", "signal_ref", F.array_join("tickers", ",").alias("tickers"),
                                                                              "n_merged", "adjusted_score", "rank")
