"""Toxic spans with a linear-chain conditional random field; marginals give document scores and offsets."""
from __future__ import annotations

import math
import re
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import bucket5, let, pieces, small_batches, text_of, written

TOKEN = re.compile(r"[^\W_]+")
TOKEN_JAVA = r"[^\p{L}\p{N}]+"


@dataclass
class Crf:
    """Two states (0 clean, 1 toxic). `words` maps a word to the log-odds it lends to state 1; other words lend `other`."""

    words: dict[str, float]
    other: float = -4.0
    move: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    slope: float = 4.0
    offset: float = -2.0


def active(model: Crf, text: str) -> tuple[list[tuple[int, int, int, str]], int]:
    """(token index, start, end, word) of the tokens with a weight of their own, and the number of tokens (none: 0)."""
    found, n = [], 0
    words = model.words
    lower = text.lower()
    if len(lower) != len(text):  # a few letters change length: lower one by one, so that offsets hold
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if words.keys().isdisjoint(TOKEN.findall(lower)):
        return found, n
    for n, hit in enumerate(TOKEN.finditer(lower), 1):
        if hit[0] in words:
            found.append((n - 1, hit.start(), hit.end(), hit[0]))
    return found, n


Square = tuple[float, float, float, float]


def times(x: Square, y: Square) -> Square:
    """Product of two 2 x 2 matrices, scaled to stay finite."""
    a, b = x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3]
    c, d = x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3]
    top = max(a, b, c, d)
    return a / top, b / top, c / top, d / top


def powers(step: Square, gap: int) -> Square:
    """step ** gap: the clean words between two active tokens in one factor."""
    out = (1.0, 0.0, 0.0, 1.0)
    while gap:
        if gap & 1:
            out = times(out, step)
        step = times(step, step)
        gap >>= 1
    return out


def marginals(model: Crf, at: list[int], odds: list[float], n: int) -> tuple[list[float], list[list[float]]]:
    """P(state 1) at the active tokens, and P(state before, state) there, by forward-backward over active tokens only.

    Runs of other words are powers of one 2 x 2 matrix, so the result equals the recursion over every token. The state
    before the first token is clean.
    """
    m00, m01, m10, m11 = (math.exp(v) for v in model.move)
    calm = math.exp(model.other)
    move, step = (m00, m01, m10, m11), (m00, m01 * calm, m10, m11 * calm)
    gaps = [b - a - 1 for a, b in zip([-1, *at], at)]
    runs = [powers(step, g) for g in gaps]
    emit = [math.exp(w) for w in odds]
    left, ahead = [], []
    zero, one = 1.0, 0.0
    for run, e in zip(runs, emit):
        zero, one = zero * run[0] + one * run[2], zero * run[1] + one * run[3]
        left.append((zero, one))
        zero, one = zero * m00 + one * m10, (zero * m01 + one * m11) * e
        whole = zero + one
        zero, one = zero / whole, one / whole
        ahead.append((zero, one))
    tail = powers(step, n - 1 - at[-1])
    zero, one = tail[0] + tail[1], tail[2] + tail[3]
    p, pairs = [0.0] * len(at), [[0.0] * 4 for _ in at]
    for j in range(len(at) - 1, -1, -1):
        e = emit[j]
        below, above = ahead[j][0] * zero, ahead[j][1] * one
        p[j] = above / (below + above)
        both = [left[j][0] * m00 * zero, left[j][0] * m01 * e * one, left[j][1] * m10 * zero, left[j][1] * m11 * e * one]
        whole = sum(both)
        pairs[j] = [v / whole for v in both]
        run = times(runs[j], move)
        zero, one = run[0] * zero + run[1] * e * one, run[2] * zero + run[3] * e * one
        whole = zero + one
        zero, one = zero / whole, one / whole
    return p, pairs


def train(texts: list[tuple[str, int]], lexicon: dict[str, float], rounds: int = 40,
          rate: float = 0.5, prior: float = 0.01) -> Crf:
    """Fit word weights and moves by gradient steps on the likelihood of the token labels.

    A token is labelled toxic when its word is in `lexicon` and its text is labelled toxic. Then the score of a text,
    a logistic curve of its expected toxic tokens, is fitted to the text labels.
    """
    model = Crf(dict.fromkeys(lexicon, 0.0))
    data = []
    for text, label in texts:
        found, n = active(model, text)
        if found:
            data.append(([f[0] for f in found], [f[3] for f in found], n,
                         [int(label == 1 and f[3] in lexicon) for f in found]))
    for _ in range(rounds if data else 0):
        slope: dict[str, float] = {}
        count: dict[str, int] = {}
        shift = [0.0] * 4
        for at, words, n, gold in data:
            p, pairs = marginals(model, at, [model.words[w] for w in words], n)
            for w, g, q in zip(words, gold, p):
                slope[w] = slope.get(w, 0.0) + g - q
                count[w] = count.get(w, 0) + 1
            for j, state in enumerate(gold):
                before = gold[j - 1] if j and at[j] - at[j - 1] == 1 else 0
                for cell in range(4):
                    shift[cell] += (cell == 2 * before + state) - pairs[j][cell]
        for w, g in slope.items():
            model.words[w] += rate * (4 * g / math.sqrt(count[w]) - prior * model.words[w])
            model.words[w] = max(-12.0, min(12.0, model.words[w]))
        tokens = sum(len(d[0]) for d in data)
        model.move = tuple(max(-3.0, min(3.0, m + rate * g / tokens)) for m, g in zip(model.move, shift))
    mass = np.array([expected(model, text) for text, _ in texts] or [0.0])
    gold = np.array([label for _, label in texts] or [0])
    x = np.log1p(mass * 4)
    a, b = 0.0, 0.0
    for _ in range(30):  # Newton steps, lightly held to 0
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        grad = np.array([np.sum((gold - p) * x) - 0.1 * a, np.sum(gold - p) - 0.1 * b])
        bend = np.array([[np.sum(w * x * x) + 0.1, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.1]])
        a, b = (np.array([a, b]) + np.linalg.solve(bend, grad)).tolist()
    model.slope, model.offset = a, b
    return model


def expected(model: Crf, text: str) -> float:
    """Expected number of toxic tokens among those the model knows."""
    found, n = active(model, text)
    return sum(marginals(model, [f[0] for f in found], [model.words[f[3]] for f in found], n)[0]) if found else 0.0


def assess(model: Crf, text: str | None) -> tuple[float, list[tuple[int, int]]]:
    """Score from 0 to 1 and the offsets of tokens that are toxic rather than not."""
    found, n = active(model, text or "")
    if not found:
        return 1 / (1 + math.exp(-model.offset)), []
    p, _ = marginals(model, [f[0] for f in found], [model.words[f[3]] for f in found], n)
    score = 1 / (1 + math.exp(-(model.slope * math.log1p(4 * sum(p)) + model.offset)))
    return score, [(f[1], f[2]) for f, q in zip(found, p) if q >= 0.5]


def learn(docs: DataFrame, labels: DataFrame, sample: int = 8000, words: int = 1000) -> Crf:
    """The model from a bounded sample: the `sample` labelled ids of the training folds with the smallest hashes.

    The lexicon takes the words that toxic texts hold more often than chance explains: their log-likelihood ratio against
    equal shares is one that less than one word of the vocabulary would reach by chance, where words too rare to reach it at
    all do not count. So the rule follows the size of the sample. Near copies count as one there: texts count by their smallest hash of three words in a row. The `words`
    strongest words at most enter the model, so it has a fixed size.
    """
    marked = labels.where("toxic is not null and doc_id is not null").where(bucket5("doc_id") != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(marked), "doc_id").select("toxic", "text")
    chosen = written(chosen.distinct())
    parts = F.array_remove(F.split(F.lower("text"), TOKEN_JAVA), "")
    rows = chosen.select((F.col("toxic") == 1).alias("bad"), parts.alias("parts"))
    triples = let(F.col("parts"), lambda all: F.transform(all, lambda w, i: F.xxhash64(w, F.get(all, i + 1), F.get(all, i + 2))))
    rows = rows.select("bad", F.array_min(triples).alias("sketch"), F.array_distinct("parts").alias("parts"))
    sizes = {r["bad"]: r["n"] for r in rows.groupBy("bad").agg(F.count_distinct("sketch").alias("n")).collect()}
    share = sizes.get(True, 0) / max(1, sum(sizes.values()))
    if not 0 < share < 1:
        return train([], {})
    seen = rows.select("bad", "sketch", F.explode("parts").alias("word")).distinct().groupBy("word").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    seen = written(seen)
    both = F.col("bad") + F.col("good")
    part = lambda n, p: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (both * p))).otherwise(0.0)
    ranked = seen.where(F.col("bad") > both * share).select("word", (2 * (part("bad", share) + part("good", 1 - share))).alias("weight"),
                                                            (F.log((F.col("bad") + 0.25) / share) - F.log((F.col("good") + 0.25) / (1 - share))).alias("odds"))
    rare = unlikely({r["n"]: r["words"] for r in seen.groupBy(F.least(both, F.lit(64)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()}, share)
    best = ranked.where((F.col("weight") >= rare) & (F.col("odds") > math.log(2))).orderBy(F.desc("weight"), "word").limit(words).collect()
    lexicon = {r["word"]: r["odds"] for r in best}
    texts = chosen.orderBy(F.xxhash64("text"), "text").toLocalIterator() if lexicon else []
    return train([(r["text"], int(r["toxic"] == 1)) for r in texts], lexicon)


def unlikely(words: dict[int, int], share: float) -> float:
    """The log-likelihood ratio that chance gives one word at most, from the numbers of words by the texts that hold them."""
    normal = NormalDist()
    for least in range(1, 65):
        able = max(2, sum(n for k, n in words.items() if k >= least))
        limit = normal.inv_cdf(1 - 0.5 / able) ** 2
        if 2 * least * math.log(1 / share) >= limit:
            return limit
    return limit


def scorer(model: Crf):
    """Column function: text to struct<score, spans>, whole texts, null as empty."""
    kind = "struct<score:double,spans:array<struct<start:int,end:int>>>"
    arrow = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        rows = []
        for low, high in pieces(texts):
            for text in texts.slice(low, high - low).to_pylist():
                value, spans = assess(model, text)
                rows.append({"score": value, "spans": [{"start": a, "end": b} for a, b in spans]})
        return pa.array(rows, arrow)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> Column:
    """struct<score, spans> of the text of each row of `docs`, learned from `labels` (doc_id, toxic) of the training folds.

    The column is a function of the text alone, so repeated rows agree, other columns do not matter, and empty or null
    texts get the score of a text without known words. Without labels of both kinds no word is known and all scores are equal.
    An empty table gives no rows; very long texts are scored whole.
    """
    small_batches(docs.sparkSession)
    return scorer(learn(docs, labels, **options))(F.col("text").cast("string"))
