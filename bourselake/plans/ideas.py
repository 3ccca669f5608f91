"""Hints, concepts, drafts, reviews and hypotheses over all events and documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.functions import r2, r4, r6
from bourselake.operators import ideas as pl, indicators as ind
from bourselake.operators.breadth import breadth_series
from bourselake.plans.news import count_sql, quoted
from bourselake.plans.registry import query
from bourselake.plans.scanners import reactions
from bourselake.plans.views import add_view
from bourselake.session import cut_lineage
from bourselake.sources.market import Market

KINDS = {"view": ("breakout", "pivot_breakout"), "click": ("earnings_drift", "gap_up_continuation"), "signup": ("panic_reversal", "panic_reversal"),
         "error": ("news_reaction", "news_reaction"), "purchase": ("regime_shift", "research_only")}
CONDS = ("rel_volume >= 1.5", "close > high20_prev", "gap >= 4.25%", "sector leads index", "close_pos >= 0.55", "ret_1d <= -0.07", "avg_volume rising")


def tickets(m: Market):
    """One ticket per signal: hypothesis by source, mechanism by direction, regime by score."""
    s = m.signals
    number = F.col("signal_ref")
    conds = F.array(*[F.element_at(F.array(*[F.lit(c) for c in CONDS]), ((number + k * k) % len(CONDS) + 1).cast("int")) for k in range(3)])

    def kind(i):
        expr = F.lit("x")
        for name, pair in KINDS.items():
            expr = F.when(F.col("skill") == name, pair[i]).otherwise(expr)
        return expr
    return s.select(
        number.alias("id"), F.col("ticker").alias("symbol"), kind(0).alias("hypothesis_type"), kind(1).alias("entry_family"),
        F.when(F.col("direction") == "LONG", "behavior").when(F.col("direction") == "SHORT", "structure").otherwise("flow").alias("mechanism_tag"),
        F.when(F.col("raw_score") >= 0.3, "RiskOn").when(F.col("raw_score") >= 0.1, "Neutral").otherwise("RiskOff").alias("regime"),
        (F.col("raw_score") * 100).alias("priority_score"), F.array_distinct(conds).alias("conditions"))


def kind_sql(i):
    return "CASE skill " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in KINDS.items()) + " END"


COND_LIST = "[" + ", ".join(quoted(c) for c in CONDS) + "]"
add_view("tickets", "signals", f"""SELECT signal_ref AS id, ticker AS symbol, {kind_sql(0)} AS hypothesis_type, {kind_sql(1)} AS entry_family, CASE direction WHEN 'LONG' THEN 'behavior' WHEN 'SHORT' THEN 'structure' ELSE 'flow' END AS mechanism_tag,
  CASE WHEN raw_score >= 0.3 THEN 'RiskOn' WHEN raw_score >= 0.1 THEN 'Neutral' ELSE 'RiskOff' END AS regime, raw_score * 100 AS priority_score,
  LIST_DISTINCT([{COND_LIST}[signal_ref % 7 + 1], {COND_LIST}[(signal_ref + 1) % 7 + 1], {COND_LIST}[(signal_ref + 4) % 7 + 1]]) AS conditions FROM signals""")
CK = "hypothesis_type, mechanism_tag, regime"
add_view("concepts", "tickets", f"""
WITH b AS (SELECT {CK}, COUNT(*) AS ticket_count, AVG(priority_score) AS avg_priority FROM tickets GROUP BY ALL),
s AS (SELECT {CK}, LIST(symbol ORDER BY n DESC, symbol) AS symbols FROM (SELECT {CK}, symbol, COUNT(*) AS n FROM tickets GROUP BY {CK}, symbol QUALIFY ROW_NUMBER() OVER (PARTITION BY {CK} ORDER BY COUNT(*) DESC, symbol) <= 10) GROUP BY ALL),
c AS (SELECT {CK}, LIST(cond ORDER BY n DESC, cond) AS conds FROM (SELECT {CK}, cond, COUNT(*) AS n FROM (SELECT {CK}, UNNEST(conditions) AS cond FROM tickets) GROUP BY {CK}, cond QUALIFY ROW_NUMBER() OVER (PARTITION BY {CK} ORDER BY COUNT(*) DESC, cond) <= 6) GROUP BY ALL),
f AS (SELECT {CK}, entry_family AS fam FROM tickets WHERE entry_family <> 'research_only' GROUP BY {CK}, entry_family QUALIFY ROW_NUMBER() OVER (PARTITION BY {CK} ORDER BY COUNT(*) DESC, entry_family) = 1)
SELECT LOWER(CONCAT_WS('_', 'edge_concept', hypothesis_type, mechanism_tag, regime)) AS id, b.*, symbols, conds, fam FROM b LEFT JOIN s USING ({CK}) LEFT JOIN c USING ({CK}) LEFT JOIN f USING ({CK})""")


def concepts(m: Market):
    return pl.concept_cluster(tickets(m))


@query("concept_cluster", "concepts", "SELECT id, ticket_count, R4(avg_priority) AS avg_priority, ARRAY_TO_STRING(symbols, ',') AS symbols, ARRAY_TO_STRING(conds, ';') AS conditions, fam AS recommended_family FROM concepts")
def q_concepts(m):
    return concepts(m).select("id", "ticket_count", r4("avg_priority").alias("avg_priority"), F.array_join("symbols", ",").alias("symbols"),
                              F.array_join("representative_conditions", ";").alias("conditions"), "recommended_family")


@query("dominant_family", "concepts", f"SELECT {CK}, fam AS recommended_family FROM concepts WHERE fam IS NOT NULL")
def q_dominant(m):
    counts = tickets(m).filter("entry_family <> 'research_only'").groupBy(*pl.CLUSTER, "entry_family").agg(F.count("*").alias("n"))
    return pl.dominant_family(counts)


def hints(m: Market):
    """News as hints: English ones name no symbol, German ones no regime."""
    fam = F.when(F.col("source") < "src13", "pivot_breakout").when(F.col("source") < "src5", "panic_reversal")
    return m.news.select(F.col("news_id").alias("hint_id"), "title", F.concat_ws(" ", "title", "body").alias("text"), fam.alias("entry_family"),
                         F.lit("behavior").alias("mechanism_tag"), F.when(F.col("lang") == "de", "").when(F.col("lang") == "fr", "RiskOff").otherwise("RiskOn").alias("regime_bias"),
                         F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("symbol")).alias("symbols"))


add_view("phints", "news", """SELECT news_id AS hint_id, title, CONCAT_WS(' ', title, body) AS text, CASE WHEN source < 'src13' THEN 'pivot_breakout' WHEN source < 'src5' THEN 'panic_reversal' END AS entry_family,
  CASE lang WHEN 'de' THEN '' WHEN 'fr' THEN 'RiskOff' ELSE 'RiskOn' END AS regime_bias, CASE WHEN lang <> 'en' THEN symbol END AS symbol FROM news""")


add_view("concept_symbols", "tickets", f"SELECT DISTINCT LOWER(CONCAT_WS('_', 'edge_concept', {CK})) AS id, symbol FROM tickets")
add_view("hint_hits", "concepts phints concept_symbols", """
WITH j AS (SELECT DISTINCT c.id, h.title FROM concepts c JOIN phints h ON (h.symbol IS NULL OR EXISTS (SELECT 1 FROM concept_symbols s WHERE s.id = c.id AND s.symbol = h.symbol))
  AND (h.regime_bias = '' OR h.regime_bias = c.regime) AND (c.fam IS NULL OR h.entry_family IS NULL OR h.entry_family = c.fam))
SELECT * FROM j QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY title) <= 10""")


@query("concept_hint_match", "hint_hits", "SELECT id, COUNT(*) AS n, MD5(STRING_AGG(title, '|' ORDER BY title)) AS titles FROM hint_hits GROUP BY id")
def q_concept_hints(m):
    df = pl.concept_hints(concepts(m), tickets(m), hints(m))
    return df.select("id", F.size("hint_titles").cast("bigint").alias("n"), F.md5(F.array_join("hint_titles", "|")).alias("titles"))


HYP_COUNTS = ", ".join(f"{count_sql(w)} AS h{i}" for i, w in enumerate(pl.HYPOTHESIS_WORDS.values()))
HYP_TOP = "GREATEST(" + ", ".join(f"h{i}" for i in range(len(pl.HYPOTHESIS_WORDS))) + ")"
HYP_CASE = "CASE WHEN top = 0 THEN 'research_hypothesis' " + " ".join(f"WHEN h{i} = top THEN '{k}'" for i, k in enumerate(pl.HYPOTHESIS_WORDS)) + " END"
add_view("promoted", "phints", f"""
WITH t AS (SELECT *, LOWER(text) AS t FROM phints WHERE LENGTH(TRIM(title)) > 0), c AS (SELECT *, {HYP_COUNTS} FROM t), d AS (SELECT *, {HYP_TOP} AS top FROM c)
SELECT hint_id, {HYP_CASE} AS hypothesis_type, CASE WHEN regime_bias = '' THEN 'Unknown' ELSE regime_bias END AS regime, COALESCE(entry_family, 'research_only') AS entry_family, UPPER(symbol) AS symbol FROM d""")


@query("promote_hints", "promoted", "SELECT * FROM promoted")
def q_promote(m):
    return pl.promote_hints(hints(m)).select("hint_id", "hypothesis_type", "regime", "entry_family", "symbol")


@query("cap_synthetic", "promoted tickets", "SELECT hint_id FROM promoted ORDER BY hint_id LIMIT (SELECT GREATEST(CAST(CEIL(COUNT(*) * 0.05) AS BIGINT), 3) FROM tickets)")
def q_cap(m):
    return pl.cap_synthetic(tickets(m), pl.promote_hints(hints(m)), 0.05).select("hint_id")


add_view("rule_anoms", "features", "SELECT date, symbol, 'gap' AS metric, gap_z AS z FROM features WHERE ABS(gap_z) >= 2 UNION ALL SELECT date, symbol, 'rel_volume', rel_volume_z FROM features WHERE ABS(rel_volume_z) >= 2")
add_view("rules", "rule_anoms reactions regime_day", """
WITH h AS (SELECT date, NULL AS symbol, 'Breadth-supported breakout regime' AS title, 'breakout' AS hypothesis_type, 'pivot_breakout' AS entry_family, 'behavior' AS mechanism_tag FROM regime_day WHERE regime = 'RISK_ON'
UNION ALL SELECT date, NULL, 'Risk-off selectivity', 'regime_shift', NULL, 'risk_premium' FROM regime_day WHERE regime = 'RISK_OFF'
UNION ALL SELECT date, symbol, CONCAT('Positive gap shock in ', symbol), 'breakout', 'gap_up_continuation', 'behavior' FROM rule_anoms WHERE metric = 'gap' AND z >= 2.5
UNION ALL SELECT date, symbol, CONCAT('Downside overreaction watch in ', symbol), 'panic_reversal', 'panic_reversal', 'behavior' FROM rule_anoms WHERE metric = 'gap' AND z <= -2.5
UNION ALL SELECT date, symbol, CONCAT('Participation spike in ', symbol), 'breakout', 'pivot_breakout', 'flow' FROM rule_anoms WHERE metric = 'rel_volume' AND ABS(z) >= 2.5
UNION ALL SELECT date, symbol, CONCAT('News drift continuation in ', symbol), 'news_reaction', 'news_reaction', 'behavior' FROM reactions WHERE reaction_1d >= 0.01
UNION ALL SELECT date, symbol, CONCAT('News shock reversal in ', symbol), 'news_reaction', 'news_reaction', 'behavior' FROM reactions WHERE reaction_1d <= -0.01)
SELECT h.*, r.regime AS regime_bias FROM h LEFT JOIN regime_day r USING (date)""")


def rules(m: Market):
    panel = ind.feature_panel(m.bars)
    anomalies = panel.selectExpr("date", "symbol", "stack(2, 'gap', gap_z, 'rel_volume', rel_volume_z) AS (metric, z)").filter("ABS(z) >= 2")
    share = r6("pct_above_50")
    regimes = breadth_series(m.bars).select("date", F.when(share >= 0.5, "RISK_ON").when(share < 0.35, "RISK_OFF").otherwise("NEUTRAL").alias("regime"))
    return pl.rule_hints(anomalies, reactions(m).select("date", "symbol", "reaction_1d"), regimes, reaction_min=0.01)


@query("rule_hints", "rules", "SELECT date, symbol, title, hypothesis_type, entry_family, mechanism_tag, regime_bias, COUNT(*) AS n FROM rules GROUP BY ALL")
def q_rules(m):
    return rules(m).groupBy("date", "symbol", "title", "hypothesis_type", "entry_family", "mechanism_tag", "regime_bias").agg(F.count("*").alias("n"))


@query("dedupe_hints", "rules", """SELECT MIN(date) AS date, title, regime_bias FROM rules GROUP BY LOWER(TRIM(title)), LOWER(TRIM(hypothesis_type)), LOWER(TRIM(mechanism_tag)), LOWER(TRIM(regime_bias)), title, regime_bias""")
def q_dedupe_hints(m):
    return pl.dedupe_hints(rules(m), ["title", "hypothesis_type", "mechanism_tag", "regime_bias"], "date").select("date", "title", "regime_bias")


def merged_sql(name: str, source: str, hint_hits: str) -> None:
    """Views of merged concepts over the ticket view `source`: a recursion over positions with the leaders so far in a list."""
    ident = f"LOWER(CONCAT_WS('_', 'edge_concept', {CK}))"
    add_view(f"{name}_base", source, f"""
WITH b AS (SELECT {CK}, COUNT(*) AS ticket_count, AVG(priority_score) AS avg_priority FROM {source} GROUP BY ALL),
f AS (SELECT {CK}, entry_family AS fam FROM {source} WHERE entry_family <> 'research_only' GROUP BY {CK}, entry_family QUALIFY ROW_NUMBER() OVER (PARTITION BY {CK} ORDER BY COUNT(*) DESC, entry_family) = 1),
c AS (SELECT {CK}, LIST(DISTINCT LOWER(TRIM(cond))) AS items FROM (SELECT {CK}, UNNEST(conditions) AS cond FROM {source}) GROUP BY ALL),
s AS (SELECT {CK}, LIST(DISTINCT symbol) AS symbols FROM {source} WHERE symbol IS NOT NULL GROUP BY ALL)
SELECT {ident} AS id, b.*, fam, COALESCE(items, []) AS items, symbols, ROW_NUMBER() OVER (PARTITION BY hypothesis_type ORDER BY {ident}) AS i
FROM b LEFT JOIN f USING ({CK}) LEFT JOIN c USING ({CK}) LEFT JOIN s USING ({CK})""")
    add_view(f"{name}_walk", f"{name}_base", f"""
SELECT hypothesis_type, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id VARCHAR, items VARCHAR[])[]) AS led, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS leader FROM {name}_base GROUP BY 1
UNION ALL
SELECT hypothesis_type, i, CASE WHEN hit IS NULL THEN LIST_APPEND(led, STRUCT_PACK(id := id, items := items))
    ELSE LIST_TRANSFORM(led, lambda l: STRUCT_PACK(id := l.id, items := CASE WHEN l.id = hit THEN LIST_DISTINCT(LIST_CONCAT(l.items, items)) ELSE l.items END)) END, id, COALESCE(hit, id)
FROM (SELECT c.hypothesis_type, c.i, c.id, c.items, w.led, LIST_FILTER(w.led, lambda l: LEN(l.items) > 0 AND LEN(c.items) > 0
    AND LEN(LIST_INTERSECT(l.items, c.items)) > 0.75 * LEAST(LEN(l.items), LEN(c.items)))[1].id AS hit
  FROM {name}_walk w JOIN {name}_base c ON c.hypothesis_type = w.hypothesis_type AND c.i = w.i + 1)""")
    add_view(name, f"{name}_base {name}_walk {source} {hint_hits}", f"""
WITH m AS (SELECT b.*, w.leader, COALESCE(SUM(ticket_count) OVER (PARTITION BY w.leader ORDER BY b.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {name}_base b JOIN {name}_walk w ON w.id = b.id),
g AS (SELECT leader, MIN(hypothesis_type) AS hypothesis_type, STRING_AGG(id, ',' ORDER BY id) AS merged_ids, CAST(SUM(ticket_count) AS BIGINT) AS ticket_count, SUM(avg_priority * ticket_count) / SUM(ticket_count) AS avg_priority,
    ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST(mechanism_tag))), '+') AS mechanism_tag, MAX_BY(regime, CASE WHEN ticket_count > before THEN id END) AS regime,
    COALESCE(MAX_BY(fam, CASE WHEN ticket_count > before AND fam IS NOT NULL THEN id END), MIN_BY(fam, CASE WHEN fam IS NOT NULL THEN id END)) AS recommended_family,
    ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(FLATTEN(LIST(symbols)))), ',') AS symbols, ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(FLATTEN(LIST(items)))), ';') AS conditions FROM m GROUP BY leader),
e AS (SELECT leader, STRING_AGG(CONCAT(entry_family, ':', n), ',' ORDER BY entry_family) AS families FROM (SELECT w.leader, t.entry_family, COUNT(*) AS n FROM (SELECT {ident} AS cid, entry_family FROM {source}) t JOIN {name}_walk w ON w.id = t.cid
    WHERE t.entry_family <> 'research_only' GROUP BY ALL) GROUP BY 1),
h AS (SELECT leader, COUNT(DISTINCT title) AS n_hints, MD5(STRING_AGG(DISTINCT title, '|' ORDER BY title)) AS titles FROM {hint_hits} JOIN {name}_walk USING (id) GROUP BY 1)
SELECT LOWER(CONCAT_WS('_', 'edge_concept', hypothesis_type, REPLACE(mechanism_tag, '+', '_'), regime)) AS id, hypothesis_type, mechanism_tag, regime, merged_ids, ticket_count, R4(avg_priority) AS avg_priority, recommended_family,
  recommended_family IS NOT NULL AS export_ready, COALESCE(symbols, '') AS symbols, COALESCE(conditions, '') AS conditions, COALESCE(families, '') AS families, COALESCE(n_hints, 0) AS n_hints, titles
FROM g LEFT JOIN e USING (leader) LEFT JOIN h USING (leader)""")


merged_sql("merged_concepts", "tickets", "hint_hits")
add_view("all_tickets", "tickets promoted", """
SELECT symbol, hypothesis_type, entry_family, mechanism_tag, regime, priority_score, conditions FROM tickets
UNION ALL SELECT symbol, hypothesis_type, 'research_only', 'behavior', regime, 30.0, CAST([] AS VARCHAR[])
  FROM (SELECT * FROM promoted ORDER BY hint_id LIMIT (SELECT GREATEST(CAST(CEIL(COUNT(*) * 0.05) AS BIGINT), 3) FROM tickets))""")
merged_sql("every_concept", "all_tickets", "every_hint")
add_view("every_hint", "every_concept_base phints", """
WITH j AS (SELECT DISTINCT c.id, h.title FROM every_concept_base c JOIN phints h ON (h.symbol IS NULL OR LIST_CONTAINS(c.symbols, h.symbol))
  AND (h.regime_bias = '' OR h.regime_bias = c.regime) AND (c.fam IS NULL OR h.entry_family IS NULL OR h.entry_family = c.fam))
SELECT * FROM j QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY title) <= 10""")


def merged_rows(found, given, m: Market):
    df = pl.dedupe_concepts(found, given, pl.concept_hints(found, given, hints(m)))
    empty = F.array().cast("array<string>")
    families = F.transform("families", lambda f: F.concat_ws(":", f["entry_family"], f["n"].cast("string")))
    return df.select("id", "hypothesis_type", "mechanism_tag", "regime", F.array_join("merged_ids", ",").alias("merged_ids"), "ticket_count", r4("avg_priority").alias("avg_priority"),
                     "recommended_family", "export_ready", F.array_join(F.coalesce("symbols", empty), ",").alias("symbols"), F.array_join(F.coalesce("conditions", empty), ";").alias("conditions"),
                     F.coalesce(F.array_join(families, ","), F.lit("")).alias("families"), F.coalesce(F.size("hint_titles"), F.lit(0)).cast("bigint").alias("n_hints"),
                     F.md5(F.array_join("hint_titles", "|")).alias("titles"))


@query("dedupe_concepts", "merged_concepts", "SELECT * FROM merged_concepts")
def q_dedupe_concepts(m):
    return merged_rows(cut_lineage(concepts(m)), tickets(m), m)


@query("concepts", "every_concept", "SELECT * FROM every_concept")
def q_all_concepts(m):
    """Real and capped synthetic tickets clustered, merged, with the hints that speak for them."""
    real = tickets(m)
    extra = pl.cap_synthetic(real, pl.promote_hints(hints(m)), 0.05)
    extra = extra.select(F.col("hint_id").alias("id"), "symbol", "hypothesis_type", F.lit("research_only").alias("entry_family"), "mechanism_tag", "regime", "priority_score",
                         F.array().cast("array<string>").alias("conditions"))
    every = cut_lineage(real.unionByName(extra.withColumn("id", F.col("id").cast(dict(real.dtypes)["id"]))))
    return merged_rows(cut_lineage(pl.concept_cluster(every)), every, m)


def case_of(x, table, i, default):
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in table.items()) + f" ELSE {default} END"


TREND = "CASE fam " + " ".join(f"WHEN '{k}' THEN [{', '.join(quoted(c) for c in v)}]" for k, v in pl.TREND_FILTERS.items()) + " ELSE [] END"
THESIS = "CASE hypothesis_type " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in pl.THESES.items()) + " END"
PROFILES = ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]})" for k, v in pl.RISK_PROFILES.items())
add_view("drafts", "concepts", f"""
WITH v AS (SELECT c.*, UNNEST(CASE WHEN fam IS NOT NULL THEN ['core', 'conservative'] ELSE ['research_probe'] END) AS variant FROM concepts c), p(profile, risk, mp, stop, rr) AS (VALUES {PROFILES})
SELECT CONCAT_WS('_', 'draft', id, variant, profile) AS draft_id, hypothesis_type, regime, {THESIS} AS thesis, variant, COALESCE(fam, 'research_only') AS entry_family, fam IS NOT NULL AND variant <> 'research_probe' AS export_ready, conds AS conditions, {TREND} AS trend_filter,
  CAST(stop * {case_of('hypothesis_type', pl.EXITS, 0, 1.0)} AS DOUBLE) AS stop_loss_pct, CAST(GREATEST(1.5, rr + {case_of('hypothesis_type', pl.EXITS, 1, 0.0)}) AS DOUBLE) AS take_profit_rr, {case_of('hypothesis_type', pl.EXITS, 2, 10)} AS days,
  CAST(risk * CASE variant WHEN 'core' THEN 1.0 WHEN 'conservative' THEN 0.75 ELSE 0.5 END AS DOUBLE) AS risk_per_trade,
  GREATEST(CAST(ROUND_EVEN(mp * CASE variant WHEN 'core' THEN 1.0 WHEN 'conservative' THEN 0.75 ELSE 0.5 END, 0) AS INT), 1) AS max_positions FROM v, p""")


def drafts(m: Market):
    return pl.drafts(concepts(m), tuple(pl.RISK_PROFILES))


@query("drafts", "drafts", """SELECT draft_id, entry_family, export_ready, R6(stop_loss_pct) AS stop_loss_pct, R4(take_profit_rr) AS take_profit_rr, CAST(days AS BIGINT) AS time_stop_days, R6(risk_per_trade) AS risk_per_trade,
  CAST(max_positions AS BIGINT) AS max_positions, CAST(LEN(conditions) AS BIGINT) AS n_conditions, CAST(LEN(trend_filter) AS BIGINT) AS n_trend FROM drafts""")
def q_drafts(m):
    return drafts(m).select("draft_id", "entry_family", "export_ready", r6("stop_loss_pct").alias("stop_loss_pct"), r4("take_profit_rr").alias("take_profit_rr"), F.col("time_stop_days").cast("bigint"),
                            r6("risk_per_trade").alias("risk_per_trade"), F.col("max_positions").cast("bigint"), F.size("conditions").cast("bigint").alias("n_conditions"), F.size("trend_filter").cast("bigint").alias("n_trend"))


def review_sql(source: str) -> str:
    t = "LOWER(TRIM(thesis))"
    return f"""
SELECT *, CASE WHEN c1 < 30 OR c2 < 30 THEN 'REJECT' WHEN confidence >= 70 AND LEAST(c1, c2, c3, c4, c5, c6, c7, c8) >= 30 THEN 'PASS' WHEN confidence < 35 THEN 'REJECT' ELSE 'REVISE' END AS verdict FROM (
SELECT *, ROUND_EVEN((c1 * 20 + c2 * 20 + c3 * 15 + c4 * 10 + c5 * 10 + c6 * 10 + c7 * 10 + c8 * 5) / 100.0, 0) AS confidence FROM (
SELECT *, CASE WHEN nw < 3 THEN 10 WHEN nw < 10 AND dm = 0 THEN 40 ELSE LEAST(95, 50 + LEAST(dm * 10, 30) + CASE WHEN nw >= 10 THEN 10 ELSE 0 END + CASE WHEN nw > 20 THEN 10 ELSE 0 END + CASE WHEN mw > 0 THEN 10 ELSE 0 END) END AS c1,
  GREATEST(CASE WHEN n + tf >= 13 THEN 10 WHEN n + tf >= 11 THEN 40 WHEN n + tf >= 8 THEN 60 WHEN n + tf >= 5 THEN 80 ELSE 90 END - pr * 10, 0) AS c2,
  CASE WHEN est < 10 THEN 10 WHEN est <= 29 THEN 30 + ROUND_EVEN((est - 10) / 19.0 * 29, 0) WHEN est <= 49 THEN 65 + ROUND_EVEN((est - 30) / 19.0 * 9, 0) WHEN est <= 99 THEN 75 + ROUND_EVEN((est - 50) / 49.0 * 10, 0) ELSE 85 + ROUND_EVEN((LEAST(est, 200) - 100) / 100.0 * 10, 0) END AS c3,
  CASE WHEN regime IN ('', 'Unknown', 'Neutral') THEN 80 ELSE 40 END AS c4, CASE WHEN stop_loss_pct > 0.15 OR take_profit_rr < 1.5 THEN 10 ELSE 80 END AS c5,
  CASE WHEN risk_per_trade > 0.02 OR max_positions > 10 THEN 10 WHEN risk_per_trade > 0.015 THEN 40 ELSE 80 END AS c6,
  CASE WHEN export_ready AND entry_family = 'research_only' THEN 10 WHEN NOT CONTAINS(LOWER(jc), 'volume') THEN 50 ELSE 80 END AS c7, 80 AS c8 FROM (
SELECT *, GREATEST(FLOOR(FLOOR(FLOOR(CASE WHEN CONTAINS(LOWER(jc), 'sector') THEN 84 ELSE 252 END / CASE WHEN regime IN ('', 'Unknown', 'Neutral') THEN 1 ELSE 2 END) * POW(CAST(0.8 AS DOUBLE), n) + 1e-9) * POW(CAST(0.85 AS DOUBLE), tf) + 1e-9), 1) AS est FROM (
SELECT *, LEN(LIST_FILTER(STRING_SPLIT({t}, ' '), lambda w: w <> '')) AS nw, {count_sql(pl.DOMAIN_TERMS, t)} AS dm, {count_sql(pl.MECHANISM_WORDS, t)} AS mw, LEN(conditions) AS n, LEN(trend_filter) AS tf, ARRAY_TO_STRING(conditions, ' ; ') AS jc,
  LEN(REGEXP_EXTRACT_ALL(ARRAY_TO_STRING(conditions, ' ; '), '\\b\\d{{2,}}\\.\\d+\\b|\\b\\d+\\.\\d{{2,}}\\b')) AS pr FROM {source}))))"""


add_view("reviewed", "drafts", review_sql("drafts"))
CR = ("c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8")
REVIEW_OUT = "draft_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in CR) + ", CAST(confidence AS BIGINT) AS confidence, verdict"


@query("draft_review", "reviewed", f"SELECT {REVIEW_OUT}, verdict = 'PASS' AND export_ready AND entry_family <> 'research_only' AS export_eligible FROM reviewed")
def q_review(m):
    return pl.review(drafts(m)).select("draft_id", *CR, "confidence", "verdict", "export_eligible")


@query("review_loop")
def q_loop(m):
    return pl.review_loop(drafts(m)).select("draft_id", "iteration", "verdict", "confidence", "variant", "export_ready", "downgraded")


@query("hypothesis_rank", "", "WITH c AS (SELECT c_custkey, " + ", ".join(f"(c_custkey // {k}) % 6 AS {n}" for n, k in zip(pl.RANK_WEIGHTS, (1, 2, 3, 5, 7, 11))) + ")".replace(")", " FROM customer)")
       + "SELECT c_custkey, CONCAT_WS(',', " + ", ".join(f"CASE WHEN {n} < 1 THEN '{n}' END" for n in pl.RANK_WEIGHTS) + ") AS errors, R4(CASE WHEN LEAST(" + ", ".join(pl.RANK_WEIGHTS) + ") >= 1 THEN "
       + " + ".join(f"{n} * {w}" for n, w in pl.RANK_WEIGHTS.items()) + " END) AS priority_score FROM c")
def q_hyp_rank(m):
    cards = m.table("customer").select("c_custkey", *[(F.floor(F.col("c_custkey") / k) % 6).cast("double").alias(n) for n, k in zip(pl.RANK_WEIGHTS, (1, 2, 3, 5, 7, 11))])
    return pl.rank_hypotheses(cards).select("c_custkey", F.array_join("errors", ",").alias("errors"), r4("priority_score").alias("priority_score"))


@query("hypothesis_intake", "", """SELECT conv_id, turn, CONCAT_WS(',', CASE WHEN TRIM(role) = '' THEN 'role' END, CASE WHEN text IS NULL OR TRIM(text) = '' THEN 'text' END, CASE WHEN role <> 'user' THEN 'risk_constraints' END) AS errors FROM conversations""")
def q_intake(m):
    bundles = m.table("conversations").withColumn("risk_constraints", F.when(F.col("role") == "user", F.array("text")))
    return pl.intake(bundles, ["role", "text"], ["risk_constraints"]).select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@query("evidence_extract", "", """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'promising' WHEN turn % 3 = 0 THEN '' ELSE 'Failed' END AS o, TRIM(text) AS note FROM conversations)
SELECT conv_id, turn, CASE WHEN o <> 'promising' AND note <> '' THEN MD5(CONCAT('[', CASE WHEN o = '' THEN 'unknown' ELSE LOWER(o) END, '] ', note)) ELSE '' END AS rejected, CAST(2 AS BIGINT) AS n_regime FROM t""")
def q_evidence(m):
    outcome = F.when(F.col("role") == "user", "promising").when(F.col("turn") % 3 == 0, "").otherwise("Failed")
    bundles = m.table("conversations").select("conv_id", "turn", F.array(F.struct(outcome.alias("outcome"), F.col("text").alias("note"))).alias("snippets"),
                                              F.array("role").alias("regime_tags"), F.array("role").alias("observations"), F.array("role").alias("execution_constraints"), F.array("role").alias("risk_constraints"))
    first = F.try_element_at("rejected_directions", F.lit(1))
    return pl.evidence(bundles).select("conv_id", "turn", F.when(first.isNotNull(), F.md5(first)).otherwise("").alias("rejected"), F.size("regime_characteristics").cast("bigint").alias("n_regime"))


FAM_COUNTS = {k: count_sql(w) for k, w in sorted(pl.FAMILY_WORDS.items())}


@query("entry_family_infer", "news", f"""WITH t AS (SELECT news_id, LOWER(CONCAT_WS(' ', title, body)) AS t FROM news), c AS (SELECT news_id, t, {FAM_COUNTS['gap_up_continuation']} AS g, {FAM_COUNTS['pivot_breakout']} AS p FROM t)
SELECT news_id, CASE WHEN CONTAINS(t, 'gap_open_scored') OR CONTAINS(t, 'gap open scored') OR GREATEST(g, p) = 0 THEN NULL WHEN g >= p THEN 'gap_up_continuation' ELSE 'pivot_breakout' END AS entry_family FROM c""")
def q_family(m):
    return m.news.select("news_id", pl.entry_family(F.lower(F.concat_ws(" ", "title", "body"))).alias("entry_family"))


@query("hypothesis_guards")
def q_guards(m):
    """Conversation turns in bundles of five cards, checked for duplicates."""
    cards = m.table("conversations").select(
        F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 5).cast("string")).alias("bundle"), F.col("turn").alias("seq"),
        F.concat("role", F.floor(F.col("turn") / 2).cast("string")).alias("hypothesis_id"), F.split("text", "\n")[0].alias("title"), F.col("role").alias("mechanism"))
    return pl.guards(cards)
