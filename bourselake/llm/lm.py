"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""
from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import bucket5, text_of, written

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END, START = xxhash.xxh64_intdigest(b"", 1), xxhash.xxh64_intdigest(b"", 2)
CHUNK = 1 << 20  # tokens held by a task before it writes them
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that one hash gives many."""
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def tokens(raw: bytes | None) -> list[int]:
    """Hashes of the words of a text, then the end token."""
    h = xxhash.xxh64_intdigest
    return [*map(h, (raw or b"").translate(LOWER).split()), END]


def pairs_of(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(context * MIX + token)


def contexts(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The token before each token; a text starts after START."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[firsts] = np.uint64(START)
    return before


def batch_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All token hashes of a batch and how many each text has."""
    each = [tokens(t) for t in column.cast(pa.binary()).to_pylist()]
    sizes = np.array([len(t) for t in each], dtype=np.int64)
    return np.fromiter(chain.from_iterable(each), dtype=np.uint64, count=int(sizes.sum())), sizes


def narrow(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes as the largest needs, which the first byte says; the low bytes of all come first."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def wide(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :blob[0]] = planes.T
    return out.reshape(-1).view("<u8")


def packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes, one at least: the first, then the steps to the next."""
    return hashes[:1].astype("<u8").tobytes() + narrow(np.diff(hashes))


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", 1), wide(blob[8:])]), dtype=np.uint64)


def cuts(keys: np.ndarray, segments: int) -> list[tuple[int, slice]]:
    """The segments that sorted hashes touch, each with its part of them; a hash's high bits name its segment."""
    cut = np.searchsorted(keys >> np.uint64(40), np.arange(segments + 1, dtype=np.uint64) * np.uint64((1 << 24) // segments))
    cut[-1] = len(keys)
    return [(k, slice(cut[k], cut[k + 1])) for k in range(segments) if cut[k] < cut[k + 1]]


def level(counts: np.ndarray, base: float) -> np.ndarray:
    """Quantised count: 1 + floor(log_base count)."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


def places(hashes: np.ndarray, j: int, k: int, bits: int) -> np.ndarray:
    """The k-th bit of entry (n-gram, level j) in a filter of `bits` bits."""
    return (mixed(hashes + np.uint64((j * 131 + k * 65537) * 2654435761 % (1 << 63))) % np.uint64(bits)).astype(np.int64)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of the hash space, from the high bits."""
    return np.minimum((hashes >> np.uint64(40)) // np.uint64((1 << 24) // segments), np.uint64(segments - 1)).astype(np.int64)


def expected(q: np.ndarray, base: float) -> np.ndarray:
    """Expected counts: the middle of the quantised step."""
    return np.where(q == 0, 0.0, np.where(q == 1, 1.0, (base ** (q - 1) + base ** q) / 2))


class Filter:
    """Log-frequency Bloom filter in segments: an n-gram of quantised count q enters as (n-gram, 1) ... (n-gram, q)."""

    def __init__(self, parts: dict[int, np.ndarray], segments: int, base: float, probes: int):
        self.parts, self.segments, self.base, self.probes = parts, segments, base, probes

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray, base: float, probes: int, per_entry: float) -> bytes:
        q = level(counts, base)
        bits = max(64, int(math.ceil(q.sum() * per_entry / 8)) * 8)
        table = np.zeros(bits, dtype=bool)
        for j in range(1, int(q.max()) + 1 if len(q) else 1):
            some = hashes[q >= j]
            for k in range(probes):
                table[places(some, j, k, bits)] = True
        return np.packbits(table, bitorder="little").tobytes()

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Quantised counts by probing level after level until one is missing; 0 for n-grams not there."""
        out = np.zeros(len(hashes), dtype=np.int64)
        own = segment_of(hashes, self.segments)
        order = np.argsort(own, kind="stable")
        edge = np.searchsorted(own[order], np.arange(self.segments + 1))
        for s, table in self.parts.items():
            left = order[edge[s]:edge[s + 1]]
            j = 1
            while len(left):
                some, ok = hashes[left], np.ones(len(left), dtype=bool)
                for k in range(self.probes):
                    at = places(some, j, k, len(table) * 8)
                    ok &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                left = left[ok]
                out[left] = j
                j += 1
        return out


def lm_scores(docs: DataFrame, segments: int | None = None, base: float = 1.5, probes: int = 4, per_entry: float = 9.0,
              prior: float = 200.0, filter_mb: int = 160, table_words: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs` (doc_id, text).

    Words are told apart by 64-bit hashes. The base score uses exact word counts. The model score is a word-pair model,
    (c(u w) + prior p(w)) / (c(u) + prior), all counts from the filters by membership probes. The texts are read once and
    written as chunks of numbered words. The distinct words and pairs of each chunk meet in their segments of the hash space
    with how often the chunk teaches them; a segment makes its filter of the sums, probes it for all that came, and the
    levels return to the chunk. So the work follows the tokens and no filter travels: `filter_mb` and `table_words`, which
    bounded what did, no longer matter. Null texts are empty and have the end token; repeated rows get equal results; other
    columns are not read.
    """
    texts = docs.select("doc_id", text_of("text").alias("text"), (bucket5("doc_id") != 1).alias("learn"))
    chunks = written(texts.mapInArrow(chunked, "chunk long, n long, ids array<long>, learn binary, sizes binary, kinds binary, tokens binary"))
    if segments is None:  # about a million tokens each, so that one fits in a task at any size of the input
        segments = max(64, (chunks.agg(F.sum("n")).first()[0] or 0) >> 20)
    parts = chunks.drop("n", "ids").mapInArrow(questions(segments), "chunk long, order int, segment int, hashes binary, counts binary")
    levels = written(parts.groupBy("order", "segment").applyInArrow(
        answers(segments, base, probes, per_entry), "chunk long, order int, segment int, levels binary, counts binary, entries long, total long"))
    sizes = {r["order"]: r for r in levels.groupBy("order").agg(F.sum("entries").alias("entries"), F.sum("total").alias("total")).collect()}
    n_all, v_all = (sizes[1]["total"], sizes[1]["entries"]) if sizes else (0, 0)
    found = chunks.drop("n", "learn").groupBy("chunk").cogroup(levels.drop("entries", "total").groupBy("chunk")).applyInArrow(
        scored(base, prior, n_all + 0.5 * (v_all + 1)), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", (bucket5("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def chunked(batches):
    """Arrow map: documents to chunks of about CHUNK tokens: ids, who teaches, tokens per text, distinct words, the tokens as their numbers."""
    def row():
        kinds, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([(task << 32) + number], pa.int64()), "n": pa.array([size], pa.int64()),
            "ids": pa.array([[d for h in held for d in h[2]]], pa.list_(pa.int64())), "learn": [narrow(np.concatenate([h[3] for h in held]))],
            "sizes": [narrow(np.concatenate([h[1] for h in held]))], "kinds": [packed(kinds)], "tokens": [narrow(back)]})

    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            held.append((*batch_tokens(part.column("text")), part.column("doc_id").to_pylist(), part.column("learn").to_numpy(zero_copy_only=False)))
            size += len(held[-1][0])
            if size >= CHUNK:
                yield row()
                number, held, size = number + 1, [], 0
    if size:
        yield row()


def words_and_pairs(sizes: bytes, kinds: bytes, tokens: bytes) -> tuple[np.ndarray, ...]:
    """Of a chunk: tokens per text, its distinct words, each token's word, the distinct pairs, each token's pair."""
    sizes, kinds, back = wide(sizes).astype(np.int64), unpacked(kinds), wide(tokens).astype(np.int64)
    hashes = kinds[back]
    return sizes, kinds, back, *np.unique(pairs_of(contexts(hashes, np.cumsum(sizes) - sizes), hashes), return_inverse=True)


def questions(segments: int):
    """Arrow map: chunks to their distinct words and pairs by segment, with their counts in texts that teach."""
    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                chunk, learn, *coded = [batch.column(c)[at].as_py() for c in ("chunk", "learn", "sizes", "kinds", "tokens")]
                sizes, *both = words_and_pairs(*coded)
                taught = np.repeat(wide(learn) > 0, sizes)
                for order, (keys, where) in ((1, both[:2]), (2, both[2:])):
                    n = np.bincount(where[taught], minlength=len(keys))
                    parts = cuts(keys, segments)
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([chunk] * len(parts), pa.int64()), "order": pa.array([order] * len(parts), pa.int32()),
                        "segment": pa.array([k for k, _ in parts], pa.int32()), "hashes": [packed(keys[p]) for _, p in parts],
                        "counts": [narrow(n[p]) for _, p in parts]})
    return run


def answers(segments: int, base: float, probes: int, per_entry: float):
    """Group map: a segment's filter from the counts of all chunks; levels of what each chunk asked, and exact counts of words.

    The entries and the total of the segment stand in its first row.
    """
    def run(table: pa.Table) -> pa.Table:
        order, segment = table.column("order")[0].as_py(), table.column("segment")[0].as_py()
        blobs = [unpacked(b) for b in table.column("hashes").to_pylist()]
        ends = np.cumsum([len(b) for b in blobs])[:-1]
        keys, back = np.unique(np.concatenate(blobs), return_inverse=True)
        n = np.bincount(back, np.concatenate([wide(b) for b in table.column("counts").to_pylist()]), len(keys)).astype(np.int64)
        blob = Filter.build(keys[n > 0], n[n > 0], base, probes, per_entry)
        q = Filter({segment: np.frombuffer(blob, np.uint8)}, segments, base, probes).levels(keys)
        rest = [0] * len(ends)
        return pa.table({
            **{c: table.column(c) for c in ("chunk", "order", "segment")}, "levels": [narrow(p) for p in np.split(q[back], ends)],
            "counts": pa.array([narrow(p) for p in np.split(n[back], ends)] if order == 1 else [None] * len(blobs), pa.binary()),
            "entries": [int((n > 0).sum()), *rest], "total": [int(n.sum()), *rest]})
    return run


def scored(base: float, prior: float, norm: float):
    """Cogroup map: a chunk and the answers of all segments to the sums of its documents."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, _, back, _, where = words_and_pairs(*[left.column(c)[0].as_py() for c in ("sizes", "kinds", "tokens")])
        right = right.sort_by([("order", "ascending"), ("segment", "ascending")])
        order = right.column("order").to_numpy()
        levels = [wide(b).astype(np.int64) for b in right.column("levels").to_pylist()]
        ones, twos = (np.concatenate([v for v, o in zip(levels, order) if o == k]) for k in (1, 2))
        exact = np.concatenate([wide(b) for b, o in zip(right.column("counts").to_pylist(), order) if o == 1]).astype(float)
        c = expected(ones, base)[back]
        of_context = np.roll(c, 1)  # before the first token of a text stands the end of another: as many start as end
        joint = np.minimum(expected(twos, base)[where], np.maximum(of_context, 0.0))
        logs = np.log10(np.minimum((joint + prior * (c + 0.5) / norm) / (of_context + prior), 1.0))
        owner, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        return pa.table({"doc_id": left.column("ids").combine_chunks().flatten(), "n_tokens": sizes, "n_known": np.bincount(owner, (exact > 0)[back], n).astype(np.int64),
                         "base_score": np.bincount(owner, np.log10((exact + 0.5) / norm)[back], n), "score": np.bincount(owner, logs, n)})
    return run
