"""Benchmark decontamination: Wu-Manber search for all benchmark word windows at once."""
from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import raw_texts
from bourselake.session import cut_lineage

WINDOW = 10
#: Lower case for A-Z; every other ASCII byte that is no digit or letter parts words. Other bytes belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
KIND = "struct<n_words:long,hits:array<int>,items:array<string>>"
ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def words_in(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(FOLD).split()


class Patterns:
    """Wu-Manber tables over words for patterns of one length.

    A block is the last two words of the search window (one for single words). `shift` says how far the window may move
    for a block that occurs in some pattern; any other block moves it past the block. Where a shift is 0, the patterns
    with that last block are compared word by word.
    """

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], set[str]]]] = defaultdict(list)
        for words, items in windows.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.ends[words[-self.block:]].append((words, items))

    def find(self, words: list[bytes], hit: set[int], items: set[str]) -> None:
        shift, most, length, block = self.shift, self.most, self.length, self.block
        end, n = length, len(words)
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = shift.get(key, most)
            if step:
                end += step
                continue
            found = tuple(words[end - length:end])
            for pattern, owners in self.ends[key]:
                if pattern == found:
                    hit.update(range(end - length, end))
                    items |= owners
            end += 1


def windows_of(items: list[tuple[str, str | None]], size: int = WINDOW) -> dict[int, dict[tuple[bytes, ...], set[str]]]:
    """Windows of the items by length: `size` words, or all words of a shorter item; items without words have none."""
    made: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_in(text)
        length = min(size, len(words))
        for start in range(len(words) - length + 1 if words else 0):
            made[length][tuple(words[start:start + length])].add(item)
    return made


def matcher(items: list[tuple[str, str | None]]):
    """Column function: text to struct<n_words, hits (word indexes), items>, whole texts."""
    tables = [Patterns(length, windows) for length, windows in sorted(windows_of(items).items())]

    @F.arrow_udf(KIND)
    def match(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in raw_texts(texts):
            words = words_in(raw)
            hit: set[int] = set()
            found: set[str] = set()
            for table in tables:
                table.find(words, hit, found)
            rows.append({"n_words": len(words), "hits": sorted(hit), "items": sorted(found)})
        return pa.array(rows, ARROW)

    return match


def with_matches(docs: DataFrame, benchmark: DataFrame, name: str, block: int = 20000) -> DataFrame:
    """`docs` with a struct column `name` (n_words, hits, items): document words inside an occurrence of a benchmark window.

    Every item is searched for in every whole text. The tables that travel to the workers hold at most `block` items at
    a time; a larger benchmark is searched in several passes over the documents, cut by checkpoints. Null texts have no
    words, null item ids count as empty ids, repeated items are the same item. Other columns pass through;
    one of the result's name is replaced. An empty table gives no rows.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string")
                             ).distinct().orderBy("item", "text")
    part: list[tuple[str, str | None]] = []
    passes = 0
    for row in items.toLocalIterator():
        part.append((row["item"], row["text"]))
        if len(part) == block:
            docs, part, passes = one_pass(docs, part, name, passes), [], passes + 1
    return one_pass(docs, part, name, passes) if part or not passes else docs


def one_pass(docs: DataFrame, part: list[tuple[str, str | None]], name: str, passes: int) -> DataFrame:
    found: Column = matcher(part)(F.coalesce(F.col("text").cast("string"), F.lit("")))
    if not passes:
        return docs.withColumn(name, found)
    both = cut_lineage(docs).withColumn(name + "_more", found)
    old, new = F.col(name), F.col(name + "_more")
    return both.withColumn(name, F.struct(old["n_words"].alias("n_words"), F.array_sort(F.array_union(old["hits"], new["hits"])).alias("hits"),
                                          F.array_sort(F.array_union(old["items"], new["items"])).alias("items"))).drop(name + "_more")


