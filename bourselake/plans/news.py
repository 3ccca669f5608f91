"""News tagging on the document and page tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.functions import r6
from bourselake.operators import news as nw
from bourselake.plans.registry import query
from bourselake.plans.views import add_view
from bourselake.sources.market import Market


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def count_sql(words, text="t"):
    return "(" + " + ".join(f"CAST(CONTAINS({text}, {quoted(w.lower())}) AS INT)" for w in words) + ")"


def any_sql(words, text="t"):
    return "(" + " OR ".join(f"CONTAINS({text}, {quoted(w.lower())})" for w in words) + ")"


def tags_sql(words):
    return "CONCAT_WS(',', " + ", ".join(f"CASE WHEN {any_sql(w)} THEN {quoted(k)} END" for k, w in words.items()) + ")"


EVENT_CASE = "CASE " + " ".join(
    f"WHEN e{i} > 0 AND e{i} = top THEN {quoted(k)}" for i, k in enumerate(nw.EVENT_WORDS)) + " ELSE 'General' END"


def classify_views(name: str, source: str, needs: str, keep: str) -> None:
    """SQL twin of the classifier over `source(title, body, ...)`."""
    n = len(nw.EVENT_WORDS)
    events = ", ".join(f"{count_sql(w)} AS e{i}" for i, w in enumerate(nw.EVENT_WORDS.values()))
    tops = ", ".join(f"e{i}" for i in range(n))
    add_view(f"{name}_counts", needs, f"SELECT *, {events}, {count_sql(nw.BULLISH)} AS up, {count_sql(nw.BEARISH)} AS dn, {tags_sql(nw.SECTOR_WORDS)} AS sectors, "
             f"{' + '.join(f'CAST({any_sql(w)} AS INT)' for w in nw.SECTOR_WORDS.values())} AS n_sectors, {tags_sql(nw.stock_words())} AS stocks, "
             f"{any_sql([k for k, v in nw.STOCK_NAMES.items() if v in nw.LARGE_CAPS])} AS large FROM (SELECT *, LOWER(CONCAT_WS(' ', title, body)) AS t FROM {source})")
    add_view(name, f"{name}_counts", f"""
WITH a AS (SELECT *, GREATEST({tops}) AS top FROM {name}_counts),
b AS (SELECT *, {EVENT_CASE} AS event_type, CASE WHEN up > dn AND (up >= 2 OR dn = 0) THEN 'Bullish' WHEN dn > up AND (dn >= 2 OR up = 0) THEN 'Bearish' ELSE 'Neutral' END AS sentiment FROM a)
SELECT {keep}, title, body, event_type, sentiment, sectors, stocks, CAST(LEAST(GREATEST(3 + CASE WHEN event_type IN ({', '.join(map(quoted, nw.HIGH_IMPACT))}) THEN 2 WHEN event_type IN ({', '.join(map(quoted, nw.MEDIUM_IMPACT))}) THEN 1 ELSE 0 END
  + CASE WHEN sentiment <> 'Neutral' THEN 1 ELSE 0 END + CASE WHEN large THEN 1 ELSE 0 END + CASE WHEN n_sectors >= 2 THEN 1 ELSE 0 END, 1), 10) AS BIGINT) AS impact FROM b""")


classify_views("tagged", "news", "news", "news_id, source, symbol, published")


@query("news_events", "tagged", "SELECT news_id, event_type FROM tagged")
def q_events(m):
    return nw.with_phrases(m.news).select("news_id", nw.event_type(F.col("found")).alias("event_type"))


@query("news_sentiment", "tagged", "SELECT news_id, sentiment FROM tagged")
def q_sentiment(m):
    return nw.with_phrases(m.news).select("news_id", nw.sentiment(F.col("found")).alias("sentiment"))


@query("news_sectors", "tagged", "SELECT news_id, sectors FROM tagged")
def q_sectors(m):
    return nw.with_phrases(m.news).select("news_id", F.array_join(nw.tagged(F.col("found"), nw.SECTOR_WORDS), ",").alias("sectors"))


@query("news_stocks", "tagged", "SELECT news_id, stocks FROM tagged")
def q_stocks(m):
    return nw.with_phrases(m.news).select("news_id", F.array_join(nw.tagged(F.col("found"), nw.stock_words()), ",").alias("stocks"))


@query("news_impact", "tagged", "SELECT news_id, impact FROM tagged")
def q_impact(m):
    return nw.classify(m.news).select("news_id", "impact")


@query("dedupe_titles", "tagged", """SELECT news_id, impact FROM tagged QUALIFY ROW_NUMBER() OVER (PARTITION BY COALESCE(NULLIF(REGEXP_REPLACE(LOWER(title), '[^\\p{L}\\p{N}]', '', 'g'), ''), title)
  ORDER BY impact DESC, source, news_id) = 1""")
def q_dedupe(m):
    df = nw.classify(m.news).select("news_id", "title", "source", "impact")
    return nw.dedupe_titles(df, "source", "news_id").select("news_id", "impact")


add_view("page_items", "", """SELECT page_id, url, COALESCE(NULLIF(TRIM(REGEXP_EXTRACT(html, '<title>([^<]*)</title>', 1)), ''), url) AS title,
  REGEXP_REPLACE(html, '<[^>]+>', '', 'g') AS body FROM pages""")
classify_views("page_tagged", "page_items", "page_items", "page_id, url")


def page_items(m: Market):
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return m.table("pages").select("page_id", "url", F.when(title == "", F.col("url")).otherwise(title).alias("title"),
                                   nw.strip_tags("html").alias("body"))


@query("news_items", "page_tagged", """SELECT page_id, title, SUBSTRING(body, 1, 300) AS summary, event_type, sentiment, sectors, impact FROM page_tagged
  QUALIFY ROW_NUMBER() OVER (PARTITION BY COALESCE(NULLIF(REGEXP_REPLACE(LOWER(title), '[^\\p{L}\\p{N}]', '', 'g'), ''), title) ORDER BY impact DESC, url, page_id) = 1""")
def q_items(m):
    """Pages: tags stripped, whole texts classified, best item per title; the summary is for display."""
    df = nw.dedupe_titles(nw.classify(page_items(m)), "url", "page_id")
    return df.select("page_id", "title", F.substring("body", 1, 300).alias("summary"), "event_type", "sentiment",
                     F.array_join("sectors", ",").alias("sectors"), "impact").orderBy(F.desc("impact"), "page_id")


@query("news_about", "page_tagged", """SELECT page_id, title, impact, stocks, sectors FROM page_tagged
  WHERE (LIST_CONTAINS(STRING_SPLIT(stocks, ','), 'BEL') OR CONTAINS(LOWER(title), 'bel') OR CONTAINS(LOWER(body), 'bel')) AND (LIST_CONTAINS(STRING_SPLIT(LOWER(sectors), ','), 'it') OR CONTAINS(LOWER(title), 'it') OR CONTAINS(LOWER(body), 'it'))
  QUALIFY ROW_NUMBER() OVER (PARTITION BY COALESCE(NULLIF(REGEXP_REPLACE(LOWER(title), '[^\\p{L}\\p{N}]', '', 'g'), ''), title) ORDER BY impact DESC, url, page_id) = 1""")
def q_about(m):
    """The news job for one stock and one sector: filtered before titles are told apart."""
    df = nw.dedupe_titles(nw.about(nw.classify(page_items(m)), "BEL", "IT"), "url", "page_id")
    return df.select("page_id", "title", "impact", F.array_join("stocks", ",").alias("stocks"), F.array_join("sectors", ",").alias("sectors"))


@query("sentiment_rollups", "tagged", """
WITH d AS (SELECT symbol, published AS date, COUNT(*) AS mentions, SUM(CASE sentiment WHEN 'Bullish' THEN 1 WHEN 'Bearish' THEN -1 ELSE 0 END) AS total FROM tagged GROUP BY 1, 2)
SELECT symbol, date, mentions, CAST(SUM(mentions) OVER w3 AS BIGINT) AS mentions_3d, R6(SUM(total) OVER w3 / CAST(SUM(mentions) OVER w3 AS DOUBLE)) AS sentiment_3d,
  CAST(SUM(mentions) OVER w7 AS BIGINT) AS mentions_7d, R6(SUM(total) OVER w7 / CAST(SUM(mentions) OVER w7 AS DOUBLE)) AS sentiment_7d FROM d
WINDOW w3 AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW), w7 AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def q_rollups(m):
    df = nw.sentiment_rollups(nw.with_phrases(m.news).withColumn("sentiment", nw.sentiment(F.col("found"))))
    return df.withColumn("sentiment_3d", r6("sentiment_3d")).withColumn("sentiment_7d", r6("sentiment_7d"))
