"""Text tagging of news by keyword containment, all as generated expressions over whole texts."""
from __future__ import annotations

import itertools
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keyword lists (matched lower-case, as substrings).
EVENT_WORDS = {
    "Earnings": ["quarterly results", "Q1", "Q2", "Q3", "Q4", "earnings", "profit", "revenue",
                 "net income", "PAT", "EBITDA", "results declared", "topline", "bottomline",
                 "YoY growth", "QoQ", "guidance"],
    "Corporate Action": ["dividend", "bonus", "stock split", "buyback", "rights issue", "face value",
                         "record date", "ex-date", "ex-dividend"],
    "M&A": ["acquisition", "merger", "demerger", "takeover", "stake sale", "buyout", "amalgamation",
            "joint venture", "strategic investment"],
    "Management": ["CEO", "MD", "chairman", "appointed", "resigned", "board", "managing director",
                   "CFO", "key managerial"],
    "Regulatory": ["SEBI", "RBI", "circular", "regulation", "compliance", "penalty", "norm",
                   "guideline", "framework", "notification"],
    "Institutional": ["FII", "FPI", "DII", "mutual fund", "bulk deal", "block deal", "institutional",
                      "promoter", "insider trading", "SAST"],
    "IPO": ["IPO", "initial public offering", "listing", "subscription", "allotment", "DRHP", "RHP",
            "anchor investor", "OFS"],
    "Macro": ["GDP", "inflation", "CPI", "WPI", "IIP", "PMI", "trade deficit", "fiscal deficit",
              "current account", "unemployment"],
    "Global": ["Fed", "US market", "Wall Street", "Nasdaq", "S&P 500", "Dow Jones", "crude oil",
               "dollar", "tariff", "global", "China", "recession"],
    "Rating": ["upgrade", "downgrade", "target price", "outperform", "underperform", "buy rating",
               "sell rating", "hold rating", "analyst"],
}
BULLISH = ["rally", "surge", "soar", "gain", "jump", "rise", "bullish", "record high", "breakout",
           "upgrade", "outperform", "beat estimate", "strong results", "positive", "boom", "recovery",
           "expansion", "growth", "optimistic", "buying", "accumulate", "all-time high"]
BEARISH = ["crash", "plunge", "sink", "fall", "drop", "decline", "bearish", "low", "breakdown",
           "downgrade", "underperform", "miss estimate", "weak results", "negative", "slump",
           "contraction", "slowdown", "pessimistic", "selling", "exit", "52-week low", "correction",
           "panic"]
SECTOR_WORDS = {
    "Banking": ["bank", "HDFC", "ICICI", "SBI", "Kotak", "Axis", "NPA", "NIM", "credit growth", "deposit"],
    "IT": ["IT", "TCS", "Infosys", "Wipro", "HCL", "Tech Mahindra", "software", "digital", "AI", "cloud"],
    "Pharma": ["pharma", "drug", "FDA", "ANDA", "API", "hospital", "healthcare", "Sun Pharma", "Dr Reddy"],
    "Auto": ["auto", "Maruti", "Tata Motors", "Bajaj", "Hero", "EV", "electric vehicle", "sales data"],
    "FMCG": ["FMCG", "HUL", "ITC", "Nestle", "Britannia", "consumer", "rural demand"],
    "Realty": ["real estate", "realty", "DLF", "Godrej Properties", "housing", "RERA"],
    "Metal": ["metal", "steel", "Tata Steel", "JSW", "Hindalco", "aluminium", "iron ore", "copper"],
    "Energy": ["oil", "gas", "ONGC", "Reliance", "BPCL", "IOC", "crude", "refining", "energy"],
    "Infra": ["infra", "L&T", "construction", "highway", "railway", "smart city", "cement"],
    "Telecom": ["telecom", "Airtel", "Jio", "Vodafone", "5G", "spectrum", "ARPU", "subscriber"],
    "Power": ["power", "NTPC", "electricity", "renewable", "solar", "wind", "grid", "transmission"],
    "Defence": ["defence", "defense", "HAL", "BEL", "BDL", "missile", "military", "arms"],
}
STOCK_NAMES = {
    "reliance": "RELIANCE", "tcs": "TCS", "infosys": "INFY", "infy": "INFY", "hdfc bank": "HDFCBANK",
    "hdfcbank": "HDFCBANK", "icici bank": "ICICIBANK", "icicibank": "ICICIBANK", "sbi": "SBIN",
    "state bank": "SBIN", "kotak": "KOTAKBANK", "axis bank": "AXISBANK", "wipro": "WIPRO",
    "hcl": "HCLTECH", "tech mahindra": "TECHM", "bharti airtel": "BHARTIARTL", "airtel": "BHARTIARTL",
    "itc": "ITC", "hindustan unilever": "HINDUNILVR", "hul": "HINDUNILVR", "larsen": "LT", "l&t": "LT",
    "bajaj finance": "BAJFINANCE", "maruti": "MARUTI", "tata motors": "TATAMOTORS",
    "sun pharma": "SUNPHARMA", "titan": "TITAN", "asian paints": "ASIANPAINT", "adani": "ADANIENT",
    "mahindra": "M&M", "m&m": "M&M", "power grid": "POWERGRID", "ntpc": "NTPC",
    "ultratech": "ULTRACEMCO", "nestle": "NESTLEIND", "bajaj auto": "BAJAJ-AUTO",
    "hero motocorp": "HEROMOTOCO", "dr reddy": "DRREDDY", "cipla": "CIPLA", "divis": "DIVISLAB",
    "grasim": "GRASIM", "britannia": "BRITANNIA", "godrej": "GODREJCP", "tata steel": "TATASTEEL",
    "jsw steel": "JSWSTEEL", "hindalco": "HINDALCO", "coal india": "COALINDIA", "ongc": "ONGC",
    "bpcl": "BPCL", "ioc": "IOC", "gail": "GAIL", "dlf": "DLF", "hal": "HAL", "bel": "BEL",
}
LARGE_CAPS = ["RELIANCE", "TCS", "HDFCBANK", "INFY", "ICICIBANK", "HINDUNILVR", "SBIN", "BHARTIARTL",
              "ITC", "KOTAKBANK", "LT", "AXISBANK", "BAJFINANCE", "MARUTI", "TATAMOTORS", "SUNPHARMA",
              "TITAN", "ASIANPAINT", "HCLTECH", "WIPRO", "NTPC", "POWERGRID"]
HIGH_IMPACT = ["M&A", "Regulatory", "Macro", "IPO"]
MEDIUM_IMPACT = ["Earnings", "Institutional", "Rating", "Global"]


def full_text(title: str = "title", body: str = "body") -> Column:
    return F.lower(F.concat_ws(" ", title, body))


def strip_tags(c) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


class Phrases:
    """All phrases of several tables, found in one pass over a text.

    The pattern is a tree of the phrases' letters behind a look-ahead, so at every position of the text it yields the
    longest phrase that starts there; every shorter one that starts there is a beginning of it and comes from a table.
    """

    def __init__(self, *tables: Mapping[str, Sequence[str]]):
        self.words = sorted({w.lower() for table in tables for words in table.values() for w in words})
        self.heads = {w: [v for v in self.words if w.startswith(v)] for w in self.words}
        self.pattern = f"(?=({self._tree([*self.words])}))"

    def _tree(self, words: list[str], depth: int = 0) -> str:
        ends = any(len(w) == depth for w in words)
        branches = []
        for letter, group in itertools.groupby([w for w in words if len(w) > depth], key=lambda w: w[depth]):
            branches.append(re.sub(r"[^\w ]", lambda m: "\\" + m[0], letter) + self._tree(list(group), depth + 1))
        if not branches:
            return ""
        joined = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
        return joined + "?" if ends else joined

    def found(self, text: Column) -> Column:
        """The distinct phrases in a lower-case text."""
        longest = F.array_distinct(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(1)))
        several = F.from_json(F.lit(json.dumps({w: h for w, h in self.heads.items() if len(h) > 1})), "map<string,array<string>>")
        return F.array_distinct(F.flatten(F.transform(longest, lambda w: F.coalesce(F.try_element_at(several, w), F.array(w)))))


def hits(found: Column, words: Sequence[str]) -> Column:
    """How many of the words are among the found phrases; a word listed twice counts twice."""
    listed = F.array(*[F.lit(w.lower()) for w in words])
    return F.size(F.filter(listed, lambda w: F.array_contains(found, w)))


def contained(text: Column, words: Sequence[str]) -> Column:
    """How many of a few words a text contains."""
    return sum((text.contains(w.lower()).cast("int") for w in words), F.lit(0))


def best_label(counts: Sequence[Column], labels: Sequence[str], none: str) -> Column:
    """The label with most hits, the first listed among equals."""
    names = F.array(*[F.lit(n) for n in labels])
    best = F.transform(F.array(F.array(*counts)), lambda c: F.when(F.array_max(c) > 0, F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))))
    return F.coalesce(F.get(best, F.lit(0)), F.lit(none))


def event_type(found: Column, words: Mapping[str, Sequence[str]] = EVENT_WORDS) -> Column:
    return best_label([hits(found, w) for w in words.values()], [*words], "General")


def sentiment(found: Column) -> Column:
    return sentiment_label(hits(found, BULLISH), hits(found, BEARISH))


def sentiment_label(up: Column, down: Column) -> Column:
    return (F.when((up > down) & ((up >= 2) | (down == 0)), "Bullish")
            .when((down > up) & ((down >= 2) | (up == 0)), "Bearish").otherwise("Neutral"))


def tagged(found: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """Labels with at least one hit, as an array in listed order."""
    return F.array_compact(F.array(*[
        F.when(F.arrays_overlap(found, F.array(*[F.lit(x.lower()) for x in w])), F.lit(label)) for label, w in words.items()]))


def stock_words() -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = {}
    for name, symbol in STOCK_NAMES.items():
        grouped.setdefault(symbol, []).append(name)
    return grouped


def impact(event: str, mood: str, sectors: str, stocks: str) -> Column:
    """Market impact from 1 to 10."""
    def one(cond: Column, points: int = 1) -> Column:
        return F.when(cond, points).otherwise(0)
    known = F.array(*[F.lit(s) for s in LARGE_CAPS])
    score = (F.lit(3) + one(F.col(event).isin(HIGH_IMPACT), 2) + one(F.col(event).isin(MEDIUM_IMPACT))
             + one(F.col(mood).isin("Bullish", "Bearish")) + one(F.arrays_overlap(stocks, known))
             + one(F.size(sectors) >= 2))
    return F.least(F.greatest(score, F.lit(1)), F.lit(10)).cast("bigint")


def every_phrase() -> Phrases:
    return Phrases(EVENT_WORDS, {"up": BULLISH, "down": BEARISH}, SECTOR_WORDS, stock_words())


def with_phrases(items: DataFrame, out: str = "found") -> DataFrame:
    """Items (title, body, ...) with the phrases of their text, each text read once.

    The row of phrases is laid through a generator, so that the optimizer does not repeat the search in every column that
    reads it.
    """
    held = F.explode(F.array(every_phrase().found(full_text())))
    return items.withColumn(out, held)


def classify(items: DataFrame) -> DataFrame:
    """Items (title, body, ...) with event, sentiment, sectors, stocks and impact."""
    df = with_phrases(items, "_found")
    found = F.col("_found")
    df = (df.withColumn("event_type", event_type(found)).withColumn("sentiment", sentiment(found))
          .withColumn("sectors", tagged(found, SECTOR_WORDS))
          .withColumn("stocks", tagged(found, stock_words())))
    return df.withColumn("impact", impact("event_type", "sentiment", "sectors", "stocks")).drop("_found")


def about(items: DataFrame, stock: str | None = None, sector: str | None = None) -> DataFrame:
    """Classified items on a stock and in a sector: tagged so, or with the name in title or body."""
    def named(name: str) -> Column:
        return F.lower("title").contains(name.lower()) | F.lower("body").contains(name.lower())
    if stock:
        items = items.filter(F.array_contains("stocks", stock.upper()) | named(stock))
    if sector:
        items = items.filter(F.exists("sectors", lambda s: F.lower(s) == sector.lower()) | named(sector))
    return items


def title_key(c="title") -> Column:
    """Letters and digits of the whole title in any script; a title without them is its own key."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return F.when(plain == "", F.col(c)).otherwise(plain)


def dedupe_titles(items: DataFrame, *ties: str) -> DataFrame:
    """Best impact per normalised title; a mergeable minimum, copies fold before the shuffle."""
    columns = [c for c in items.columns if c not in ("impact", *ties)]
    order = F.struct((-F.col("impact")).alias("_i"), *ties, "impact", *columns)
    best = items.groupBy(title_key().alias("_key")).agg(F.min(order).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in items.columns])


def sentiment_rollups(items: DataFrame, days: Sequence[int] = (3, 7)) -> DataFrame:
    """Mentions and mean sentiment per symbol over trailing calendar days."""
    score = F.when(F.col("sentiment") == "Bullish", 1).when(F.col("sentiment") == "Bearish", -1).otherwise(0)
    daily = items.groupBy("symbol", F.col("published").alias("date")).agg(
        F.count("*").alias("mentions"), F.sum(score).alias("total"))
    day = F.unix_date("date")
    for n in days:
        w = Window.partitionBy("symbol").orderBy(day).rangeBetween(-(n - 1), 0)
        daily = daily.withColumn(f"mentions_{n}d", F.sum("mentions").over(w)).withColumn(
            f"sentiment_{n}d", F.sum("total").over(w) / F.sum("mentions").over(w))
    return daily.drop("total")
