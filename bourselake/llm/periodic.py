"""Periodic runs of words: dyadic blocks look up their next occurrences by wavelet-tree range successor over a suffix array."""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import pieces, text_of

FEWEST = 6  # words of a run
TIMES = 4  # periods of a run
SCHEMA = ("doc_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
          "runs array<struct<start:long,length:long,period:long>>, collapsed string")


class Words:
    """The words of some texts: word ids in a row, with the offsets of each text."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
        some = pc.not_equal(pc.binary_length(flat), 0)
        coded = flat.filter(some).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.spellings = coded.dictionary
        counts = np.bincount(parent[some.to_numpy(zero_copy_only=False)], minlength=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def joined(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts with these word ids, one space between words."""
        lines = pa.LargeListArray.from_arrays(pa.array(offsets), self.spellings.take(pa.array(ids)))
        return pc.binary_join(lines, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()


def next_same(ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distance to the next equal word of the same text; very large where there is none."""
    order = np.argsort(ids, kind="stable")
    here, after = order[:-1], order[1:]
    again = (ids[here] == ids[after]) & (owner[here] == owner[after])
    out = np.full(len(ids), 1 << 60, dtype=np.int64)
    out[here[again]] = (after - here)[again]
    return out


def hopeful(ids: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Per level k the starts of aligned blocks of 2^k words that a run with a period from 2^k to 2^(k+1) - 1 may begin with.

    A run of period q has at least 3 q words in a row whose next equal word is at most q further on, five where q is 1; so
    the first aligned block in it, and the one behind, are full of such words. Blocks that fail this are in no run.
    """
    out, near, size = [], next_same(ids, owner), 1
    while len(near) > 1 and 3 * size < len(ids):
        good = near < 2 * size
        pair = good[:-1] & good[1:]
        if size == 1:
            pair = pair[:-3] & good[2:-2] & good[3:-1] & good[4:] if len(good) > 4 else pair[:0]
        out.append(np.flatnonzero(pair) * size)
        even = len(near) // 2 * 2
        near, size = np.maximum(near[0:even:2], near[1:even:2]), 2 * size
    return out


def rank_levels(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... words (number of smaller ones), until all differ; and the suffix array.

    `x` ends in a value that occurs once, so that no two suffixes are equal.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    first = np.concatenate([[True], x[order][1:] != x[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    levels, size = [rank.astype(np.int32)], 1
    while True:
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(open_):
            sa = np.empty(n, dtype=np.int64)
            sa[rank] = np.arange(n)
            return levels, sa
        key = rank[open_] * n + rank[open_ + size]
        order = np.argsort(key, kind="stable")
        at, key = open_[order], key[order]
        group = rank[at]
        place = np.arange(len(at))
        head = np.concatenate([[True], group[1:] != group[:-1]])
        part = np.concatenate([[True], key[1:] != key[:-1]])
        base = place[head][np.cumsum(head) - 1]
        rank = rank.copy()
        rank[at] = group + place[part][np.cumsum(part) - 1] - base
        levels.append(rank.astype(np.int32))
        size *= 2


class Wavelet:
    """Wavelet tree over a permutation, level by level; answers many range queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.split = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of positions [left, right) are less than x."""
        count = np.zeros(len(x), dtype=np.int64)
        whole = x >= 1 << self.bits
        total = right - left
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            one = (x >> bit & 1).astype(bool)
            a, b = self.zeros[level][left], self.zeros[level][right]
            count += np.where(one, b - a, 0)
            left, right = np.where(one, self.split[level] + left - a, a), np.where(one, self.split[level] + right - b, b)
        return np.where(whole, total, count)

    def nth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k among positions [left, right)."""
        out = np.zeros(len(k), dtype=np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            a, b = self.zeros[level][left], self.zeros[level][right]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            out |= one.astype(np.int64) << bit
            left, right = np.where(one, self.split[level] + left - a, a), np.where(one, self.split[level] + right - b, b)
        return out


class Index:
    """Suffix array, ranks and wavelet tree of a word sequence."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.levels, sa = rank_levels(x)
        self.tree = Wavelet(sa)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i < j."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(j + (1 << k) <= self.n)
            same = fits[self.levels[k][i[fits]] == self.levels[k][j[fits]]]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of what stands before i and before j, i < j."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(i >= 1 << k)
            fits = fits[self.levels[k][i[fits] - (1 << k)] == self.levels[k][j[fits] - (1 << k)]]
            i[fits] -= 1 << k
            j[fits] -= 1 << k
        return start - i

    def candidates(self, k: int, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) pairs among which is every run whose first aligned block of 2^k words starts at one of `a`.

        Occurrences of the block in the window from 2^k to 2^(k+1) - 1 words on: the first and the second give periods; three
        or more are a progression whose step is the period of the block, and then the run's period is the distance between
        the ends of the two stretches that keep this step, the block's own and that of the occurrences.
        """
        size = 1 << k
        left = self.levels[k][a].astype(np.int64)
        right = left + np.bincount(self.levels[k], minlength=self.n)[left]
        some = right - left > 1
        a, left, right = a[some], left[some], right[some]
        low, high = self.tree.below(left, right, a + size), self.tree.below(left, right, a + 2 * size)
        found = high > low
        a, left, right, low, many = a[found], left[found], right[found], low[found], (high - low)[found]
        first = self.tree.nth(left, right, low)
        two = many > 1
        second = self.tree.nth(left[two], right[two], low[two] + 1)
        at, period = [a, a[two]], [first - a, second - a[two]]
        three = many[two] > 2
        a, first, second = a[two][three], first[two][three], second[three]
        step = second - first
        shift = first + self.ahead(first, second) - a - self.ahead(a, a + step)
        good = shift > 0
        return np.concatenate([*at, a[good]]), np.concatenate([*period, shift[good]])


def runs_of(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (text, start, end, period) of all runs of the texts in ids[offsets[t]:offsets[t + 1]], in this order."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    none = np.zeros((0, 4), dtype=np.int64)
    touched = np.unique(np.concatenate([owner[s] for s in hopeful(ids, owner)] or [owner[:0]]))
    if not len(touched):
        return none
    # only texts with a hopeful block are indexed, each closed by a value of its own
    size = np.diff(offsets)[touched] + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    x = np.empty(begin[-1], dtype=np.int64)
    own = np.repeat(np.arange(len(touched)), size)
    ends = begin[1:] - 1
    inside = np.ones(len(x), dtype=bool)
    inside[ends] = False
    x[inside] = ids[np.isin(owner, touched)]
    x[ends] = ids.max() + 1 + np.arange(len(touched))
    index = Index(x)
    at, period = [], []
    for k, starts in enumerate(hopeful(x, own)):
        if k < len(index.levels) and len(starts):
            a, q = index.candidates(k, starts)
            at.append(a)
            period.append(q)
    if not at:
        return none
    at, period = np.concatenate(at), np.concatenate(period)
    start = at - index.behind(at, at + period)
    end = at + period + index.ahead(at, at + period)
    long = end - start >= np.maximum(FEWEST, TIMES * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[:len(start)]
    start, end, period = start[once], end[once], period[once]
    text = own[start]
    order = np.lexsort((period, start))
    return np.stack([touched[text], start - begin[text], end - begin[text], period], axis=1)[order]


def planted(words: Words, keys: list[bytes]) -> np.ndarray:
    """Word ids of the texts, of which those chosen by the crc32 of their key repeat a stretch of their words to the end."""
    ids = words.ids.copy()
    for t, key in enumerate(keys):
        low, high = int(words.offsets[t]), int(words.offsets[t + 1])
        h, n = zlib.crc32(key), high - low
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ids[low + a:high] = words.ids[low + a + np.arange(n - a) % p]
    return ids


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def described(texts: pa.Array, keys: list[bytes] | None) -> Iterator[dict]:
    """Per text its runs and what is left when each keeps its first period; `keys` asks for the planted repeats first."""
    words = Words(texts)
    ids = words.ids if keys is None else planted(words, keys)
    found = runs_of(ids, words.offsets) if len(ids) else np.zeros((0, 4), dtype=np.int64)
    drop = np.zeros(len(ids) + 1, dtype=np.int64)
    base = words.offsets[found[:, 0]]
    np.add.at(drop, base + found[:, 1] + found[:, 3], 1)
    np.add.at(drop, base + found[:, 2], -1)
    keep = np.cumsum(drop)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(keep)])[words.offsets]
    collapsed = words.joined(ids[keep], left)
    bounds = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    for t in range(len(texts)):
        triples = [(s, e - s, q) for _, s, e, q in found[bounds[t]:bounds[t + 1]].tolist()]
        best = min(triples, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        yield {"n_runs": len(triples), "start": best[0], "length": best[1], "period": best[2],
               "exponent_milli": best[1] * 1000 // best[2] if triples else None, "runs": triples, "collapsed": collapsed[t]}


def periodic_runs(docs: DataFrame, plant: bool = False, whole: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): its runs of repeated words, and digests of them and of the text without repeats.

    A run is a stretch of words with smallest period q, at least max(6, 4 q) long, that no neighbouring word extends. The
    run with the greatest length / period (then smallest start, then period) fills start, length, period, exponent_milli.
    A word that stands in a run behind the run's first q words is dropped from the collapsed text. `plant` first overwrites
    the end of some texts with repeats, chosen by their ids. `whole` adds `runs` and `collapsed` themselves.

    Null and blank texts have no words: no run, nulls, digests of the empty text. A null id counts as empty text. Repeated
    rows get equal results, an empty table no rows; other columns are not read. Texts need memory of about their number of
    words times the logarithm of the longest repeat, and no shuffle.
    """
    def work(batches):
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            for low, high in pieces(texts):
                own = doc_ids.slice(low, high - low)
                keys = [b"" if d is None else str(d).encode() for d in own.to_pylist()] if plant else None
                rows = list(described(texts.slice(low, high - low), keys))
                columns = {"doc_id": own, **{c: pa.array([r[c] for r in rows], pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")}}
                columns["runs_sha256"] = pa.array([sha("".join(f"{a},{b},{c}\n" for a, b, c in r["runs"]).encode()) for r in rows])
                columns["collapsed_sha256"] = pa.array([sha(r["collapsed"]) for r in rows])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                columns["runs"] = pa.array([[dict(zip(("start", "length", "period"), t)) for t in r["runs"]] if whole else None for r in rows], kind)
                columns["collapsed"] = pa.array([r["collapsed"].decode() if whole else None for r in rows], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    kind = dict(docs.dtypes)["doc_id"]
    made = docs.select("doc_id", text_of("text").alias("text")).mapInArrow(work, SCHEMA.format(id=kind))
    return made if whole else made.drop("runs", "collapsed")
