"""Near duplicates by SimHash: generalised pigeonhole over unequal bit partitions, then components of the links."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from bourselake.llm.common import fresh, raw_texts, written

BITS = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HOT = 64  # members of a partition value that are still compared one by one


def fingerprint(raw: bytes | None, size: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles of a text; no word: 0."""
    words = (raw or b"").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - size + 1)
    starts, stops = [0, *ends][:n], ends[min(size, len(words)) - 1:]
    hashes = np.array([xxhash.xxh64_intdigest(line[a:b - 1], 42) for a, b in zip(starts, stops)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    found = np.array([fingerprint(t) for t in raw_texts(texts)], dtype=np.uint64)
    return pa.array(found.view(np.int64))


def bits_of(numbers: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(numbers, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(prints: DataFrame, parts: int) -> list[list[int]]:
    """Bits grouped so that correlated bits share a partition, from pair counts over all fingerprints (a 64 x 64 table)."""
    def count(batches):
        total = np.zeros((BITS, BITS), dtype=np.int64)
        n = 0
        for batch in batches:
            b = bits_of(batch.column("fp").to_numpy()).astype(np.float32)
            total += (b.T @ b).astype(np.int64)
            n += len(b)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)})

    rows = prints.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for row in rows:
        flat[row["cell"]] = row["n"]
    n = max(flat[-1], 1.0)
    joint = flat[:-1].reshape(BITS, BITS) / n
    mean = np.diag(joint)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    tied = np.abs(joint - np.outer(mean, mean)) / np.outer(spread, spread)
    free, groups = list(range(BITS)), []
    sizes = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    for size in sizes:
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (tied[b, group].mean(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def part_values(numbers: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, gathered into one number per fingerprint."""
    raw = numbers.view(np.uint64)
    out = np.zeros(len(raw), dtype=np.uint64)
    for k, bit in enumerate(group):
        out |= ((raw >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


class Plan:
    """Estimated candidates and the thresholds that make them fewest.

    `seen[i]` counts the fingerprints by the first 16 bits of partition i, a table of fixed size; the rest of the
    partition is taken as even. A threshold of -1 leaves a partition out. Thresholds add up to `limit` - parts + 1, so
    two fingerprints within `limit` bits agree within the threshold of some partition.
    """

    def __init__(self, groups: list[list[int]], seen: list[np.ndarray], limit: int):
        self.groups, self.limit = groups, limit
        self.costs = []
        for group, count in zip(groups, seen):
            w = len(group)
            low = min(w, 16)
            near = lambda h, low=low: sum(h[np.arange(len(h)) ^ (1 << b)] for b in range(low))
            scale = 2.0 ** (w - low)
            one = near(count)
            two = (near(one) - low * count) / 2
            at0 = count / scale
            at1 = at0 + (one + (w - low) * count) / scale
            at2 = at1 + (two + (w - low) * one + (w - low) * (w - low - 1) / 2 * count) / scale
            self.costs.append([np.zeros_like(at0), at0 + 1, at1 + 1 + w, at2 + 1 + w + w * (w - 1) / 2])

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """Per fingerprint and partition the threshold, by dynamic programming over the sum of thresholds."""
        parts, n = len(self.groups), len(values[0])
        low, goal = -parts, self.limit - parts + 1
        width = self.limit - low + 1
        best = np.full((n, width), np.inf)
        best[:, -low] = 0.0
        choice = []
        for k in range(parts):
            cost = [c[(values[k] & np.uint64(0xFFFF)).astype(np.int64)] for c in self.costs[k]]
            now = np.full((n, width), np.inf)
            took = np.zeros((n, width), dtype=np.int8)
            for t in range(-1, self.limit + 1):
                source = best[:, max(0, -t):width - max(0, t)] + cost[t + 1][:, None]
                target = now[:, max(0, t):width - max(0, -t)]
                better = source < target
                target[better] = source[better]
                took[:, max(0, t):width - max(0, -t)][better] = t
            best = now
            choice.append(took)
        out = np.zeros((n, parts), dtype=np.int8)
        at = np.full(n, goal - low)
        for k in range(parts - 1, -1, -1):
            out[:, k] = choice[k][np.arange(n), at]
            at -= out[:, k]
        return out


def prober(plan: Plan):
    """Arrow map: fp to rows (fp, part, value, probe); probe false is the index entry, true a signature to look up."""
    def run(batches):
        for batch in batches:
            prints = batch.column("fp").to_numpy().astype(np.int64)
            if not len(prints):
                continue
            values = [part_values(prints, g) for g in plan.groups]
            limits = plan.thresholds(values)
            for k, group in enumerate(plan.groups):
                yield rows(prints, k, values[k], False)
                for t in range(plan.limit + 1):
                    pick = limits[:, k] >= t
                    for mask in flips(len(group), t):
                        if pick.any():
                            yield rows(prints[pick], k, values[k][pick] ^ np.uint64(mask), True)

    def rows(prints, k, values, probe):
        n = len(prints)
        return pa.RecordBatch.from_pydict({"fp": prints, "part": np.full(n, k, dtype=np.int32), "value": values.view(np.int64),
                                           "probe": np.full(n, probe)})
    return run


def flips(width: int, count: int) -> list[int]:
    if count == 0:
        return [0]
    if count == 1:
        return [1 << a for a in range(width)]
    return [1 << a | 1 << b for a in range(width) for b in range(a)]


def links(prints: DataFrame, limit: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within `limit` (2) bits.

    Partition values with up to HOT members are probed and verified pair by pair. Whoever meets a larger one takes an
    exact way of linear size: two fingerprints are within 2 bits just if some point is within 1 bit of both, so each
    lists its 65 such points and the at most 65 members of a point are tied to the smallest.
    """
    if limit != 2:
        raise ValueError("the way around large partition values is exact for two bits")
    n = prints.count()
    parts = max(2, min(8, BITS // max(8, int(np.ceil(np.log2(n + 1))))))
    groups = bit_groups(prints, parts)

    def tally(batches):
        seen = [np.zeros(1 << min(16, len(g)), dtype=np.int64) for g in groups]
        for batch in batches:
            for k, g in enumerate(groups):
                v = part_values(batch.column("fp").to_numpy().astype(np.int64), g[:16])
                seen[k] += np.bincount(v.astype(np.int64), minlength=len(seen[k]))
        for k, s in enumerate(seen):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"part": np.full(len(at), k, dtype=np.int32), "value": at, "n": s[at]})

    seen = [np.zeros(1 << min(16, len(g))) for g in groups]
    for row in prints.mapInArrow(tally, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).collect():
        seen[row["part"]][row["value"]] = row["n"]  # at most 65,536 rows per partition
    probes = written(prints.mapInArrow(prober(Plan(groups, seen, limit)), "fp long, part int, value long, probe boolean"))
    key = ["part", "value"]
    index, asked = probes.where("not probe").drop("probe"), probes.where("probe").drop("probe")
    large = written(index.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(*key))
    small = index.join(large, key, "left_anti").withColumnRenamed("fp", "other")
    found = asked.join(small, key).where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= limit))
    pairs = found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    many = probes.join(large, key, "left_semi").select("fp").distinct()
    around = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.col("fp").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    tied = many.select("fp", F.explode(around).alias("point")).groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    tied = tied.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a != b")
    return pairs.unionByName(tied).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, by alternating large-star and small-star steps until nothing moves.

    Each step keeps one edge per node to a smallest neighbour, so a hub costs rows in proportion to its neighbours, and
    its join is one that Spark splits. State is written to the shared folder after each round.
    """
    edges = written(edges.select("a", "b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("v"), F.col("m").alias("w")).where("v != w").distinct()
        down = large.select(F.greatest("v", "w").alias("u"), F.least("v", "w").alias("n"))
        lowest = down.groupBy("u").agg(F.min("n").alias("m"))
        small = down.join(lowest, "u").select(F.col("n").alias("v"), "m").unionByName(lowest.select(F.col("u").alias("v"), "m"))
        edges = written(small.where("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        after = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs` (doc_id, text): the smallest doc_id reachable over links.

    Equal fingerprints are one node, so copies cost no pairs. Null text has no words and fingerprint 0, linked like any
    other. Null ids count only where a component has no other (then null). Repeated rows share their component; an empty
    table gives no rows; other columns are not read.
    """
    marked = written(docs.select("doc_id", fingerprints(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("fp")))
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = written(components(links(nodes.select("fp"))))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "root").join(best, "root"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` less near duplicates: of each component the row with the smallest doc_id (null last) stays.

    Of repeated rows with that id one stays, the one with the smallest text. An empty table gives no rows; other columns pass
    through, whatever their names.
    """
    chosen_id, copies, own, whole = fresh(docs, "_chosen", "_rows", "_id", "_row")
    marked = near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    firsts = marked.groupBy("component_id").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("n"))
    once = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    chosen = firsts.select(F.col("k.doc_id").alias("doc_id")).distinct()
    chosen = written(chosen.join(once, chosen["doc_id"].eqNullSafe(once["doc_id"])).select(
        chosen["doc_id"].alias(chosen_id), F.col("rows").alias(copies)))
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[chosen_id]))
    single = kept.where(F.col(copies) == 1).select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    several = kept.where(F.col(copies) > 1).select(*docs.columns)
    several = several.groupBy(F.col("doc_id").alias(own)).agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias(whole)).select(f"{whole}.*")
    return single.unionByName(several)
