"""Exact top-k by inner product: bounds from segment means and deviations, coarse to fine, exact scores for survivors."""
from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 2048  # vectors of a block at most
BYTES = 4 << 20  # bytes of a block at most, one vector at least
CELL = (1 << 16, 1 << 20)  # queries and candidates that one join key brings together, about
HELD = 32 << 20  # bytes of query vectors whose best scores a task remembers
BLOCK = "block long, ids binary, lengths binary, data binary, n int"
EXACT = 1 << 53  # whole numbers below this are exact as doubles
LONG = 2 ** 63 - 1


def scaled(vector: Column, factor: int = 256) -> Column:
    """Each component as floor(factor * x) in 64 bits; null where the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    limit = float(1 << 62)
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v * factor, F.lit(limit)), F.lit(-limit))), F.lit(1 << 62)), F.lit(-(1 << 62))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, v) as blocks of vectors with padding of zeros, each of bounded size, packed where they lie."""
    def work(batches):
        from pyspark import TaskContext
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, vectors = batch.column("id"), batch.column("v")
            lengths = np.diff(vectors.offsets.to_numpy())
            low = 0
            while low < len(lengths):
                # a block ends before its padded size passes the bound
                wide = np.maximum.accumulate(lengths[low:low + most]) * np.arange(1, len(lengths[low:low + most]) + 1) * 8
                high = low + max(1, int(np.searchsorted(wide, BYTES, side="right")))
                part = vectors.slice(low, high - low)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                size = lengths[low:high]
                grid = np.zeros((high - low, int(size.max())), dtype=np.int64)
                grid[np.arange(grid.shape[1]) < size[:, None]] = flat
                own = ids.slice(low, high - low)
                key = own.fill_null(-LONG - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"block": pa.array([serial], pa.int64()), "ids": pa.array([key.tobytes()]),
                                                  "lengths": pa.array([size.astype(np.int64).tobytes()]), "data": pa.array([grid.tobytes()]),
                                                  "n": pa.array([high - low], pa.int32())})
                serial += 1
                low = high
    return rows.mapInArrow(work, BLOCK)


class Block:
    """Vectors of a block as whole numbers and doubles, with segment features per level."""

    def __init__(self, ids: bytes, data: bytes, n: int):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.whole = np.frombuffer(data, dtype=np.int64).reshape(n, -1)
        self.x = self.whole.astype(np.float64)
        self.most = float(np.sqrt((self.x ** 2).sum(axis=1)).max(initial=0.0))
        self.features: dict[int, np.ndarray] = {}

    def padded(self, width: int) -> np.ndarray:
        return self.x if self.x.shape[1] == width else np.pad(self.x, ((0, 0), (0, width - self.x.shape[1])))

    def level(self, width: int, parts: int) -> np.ndarray:
        """Per vector and segment: mean and deviation, each times the root of the segment's length.

        The inner product of two such rows bounds that of the vectors from above, since within a segment of L components
        sum(q x) = L mean(q) mean(x) + sum((q - mean(q)) (x - mean(x))), and the last sum is at most L dev(q) dev(x).
        """
        if (width, parts) not in self.features:
            x = self.padded(width)
            cuts = width * np.arange(parts) // parts
            size = np.diff(np.append(cuts, width))
            mean = np.add.reduceat(x, cuts, axis=1) / size
            rest = x - np.repeat(mean, size, axis=1)
            dev = np.sqrt(np.add.reduceat(rest ** 2, cuts, axis=1))
            self.features[width, parts] = np.concatenate([mean * np.sqrt(size), dev], axis=1)
        return self.features[width, parts]


def levels(width: int) -> list[int]:
    """Numbers of segments, coarse to fine, while a bound costs less than the exact score."""
    return [p for p in (max(1, width // 32), width // 16, width // 8, width // 4) if 0 < 2 * p < width] if width >= 8 else []


def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of chosen row pairs, in pieces of bounded size."""
    step = max(1, (1 << 21) // max(1, a.shape[1]))
    return np.concatenate([np.einsum("nd,nd->n", a[i[s:s + step]], b[j[s:s + step]]) for s in range(0, len(i), step)] or [np.zeros(0, a.dtype)])


def exact(q: Block, c: Block, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """Integer inner products; beyond 64 bits the nearest 64-bit number."""
    if q.most * c.most < EXACT / 2:
        return dots(q.padded(width), c.padded(width), i, j).astype(np.int64)
    size = min(q.whole.shape[1], c.whole.shape[1])
    pairs = zip(q.whole[i, :size].tolist(), c.whole[j, :size].tolist())
    return np.array([max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(x, y)))) for x, y in pairs], dtype=np.int64)


class Best:
    """The k best (score, id) so far of each query of a block."""

    def __init__(self, q: Block, k: int):
        self.q, self.k = q, k
        self.query, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.floor = np.full(len(q.ids), -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        query, score, other = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, other)))
        # a null id, kept as the least number, comes last among ties
        tie = np.where(other == -LONG - 1, LONG, other)
        order = np.lexsort((tie, ~score, query))
        query, score, other = query[order], score[order], other[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], other[kept]
        last = place[kept] == self.k - 1
        self.floor[self.query[last]] = self.score[last]

    def meet(self, c: Block) -> None:
        q, width = self.q, max(self.q.x.shape[1], c.x.shape[1])
        slack = 1e-9 * q.most * c.most + 1e-6
        own = q.ids[:, None] == c.ids[None, :]
        steps = levels(width)
        if not steps or not np.isfinite(q.most * c.most):
            i, j = np.nonzero(~own)
        else:
            bound = q.level(width, steps[0]) @ c.level(width, steps[0]).T
            bound[own] = -np.inf
            if np.isinf(self.floor).any():
                # the candidates with the highest coarse bounds give a first floor
                some = min(4 * self.k, bound.shape[1])
                j = np.argpartition(-bound, some - 1, axis=1)[:, :some].ravel()
                i = np.repeat(np.arange(len(q.ids)), some)
                real = ~own[i, j]
                score = exact(q, c, i[real], j[real], width)
                low = Best(q, self.k)
                low.add(i[real], score, c.ids[j[real]])
                floor = np.maximum(self.floor, low.floor)
            else:
                floor = self.floor
            i, j = np.nonzero(bound >= (floor - slack)[:, None])
            kept = ~own[i, j]
            i, j = i[kept], j[kept]
            for parts in steps[1:]:
                a, b = q.level(width, parts), c.level(width, parts)
                # where many pairs are left, one product of all costs less than theirs
                bounds = (a @ b.T)[i, j] if 8 * len(i) > own.size else dots(a, b, i, j)
                kept = bounds >= floor[i] - slack
                i, j = i[kept], j[kept]
        if 8 * len(i) > own.size and q.most * c.most < EXACT / 2:
            score = (q.padded(width) @ c.padded(width).T)[i, j].astype(np.int64)
        else:
            score = exact(q, c, i, j, width)
        good = score >= self.floor[i]
        self.add(i[good], score[good], c.ids[j[good]])

    def rows(self) -> pa.RecordBatch:
        other = pa.array(self.id, mask=self.id == -LONG - 1)
        return pa.RecordBatch.from_pydict({"query_id": self.q.ids[self.query], "vec_id": other, "score": self.score})


def searched(k: int):
    """Arrow map over pairs of blocks to the k best of each query seen so far; a task remembers a bounded number of query blocks."""
    def work(batches) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Best] = OrderedDict()
        candidates: OrderedDict[int, Block] = OrderedDict()
        size = 0
        for batch in batches:
            for r in range(batch.num_rows):
                qb, cb = batch.column("block")[r].as_py(), batch.column("c_block")[r].as_py()
                if qb not in held:
                    held[qb] = Best(Block(batch.column("ids")[r].as_py(), batch.column("data")[r].as_py(), batch.column("n")[r].as_py()), k)
                    size += held[qb].q.x.nbytes
                held.move_to_end(qb)
                if cb not in candidates:
                    candidates[cb] = Block(batch.column("c_ids")[r].as_py(), batch.column("c_data")[r].as_py(), batch.column("c_n")[r].as_py())
                    if len(candidates) > 4:
                        candidates.popitem(last=False)
                held[qb].meet(candidates[cb])
                if size > HELD and len(held) > 1:
                    oldest = held.popitem(last=False)[1]
                    size -= oldest.q.x.nbytes
                    yield oldest.rows()
        for best in held.values():
            yield best.rows()
    return work


def cells(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def top_k(rows: DataFrame, queries: Column, k: int = 5, factor: int = 256, most: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each of `rows` (vec_id, embedding) that is in `queries` the k rows with the highest score.

    Components become floor(factor * x); the score is the integer inner product, ties go to the smaller vec_id (null last). A
    query never meets rows with its own id. Fewer rows than k give all of them. Vectors that are null or hold a null or
    non-finite component take no part; missing components of shorter vectors count as zero, so an empty one scores 0.
    Several rows with one query id share one list, in which repeated rows each count; scores and components beyond 64 bits
    are the nearest number within. An empty table, or no query, gives no rows; other columns are not read.

    Both sides are packed into blocks of bounded size and meet in cells of a grid, each cell one join key; the numbers of
    rows and columns of the grid follow the counts. Every candidate meets every query: first by bounds, then exactly.
    """
    whole = rows.select(F.col("vec_id").cast("long").alias("id"), scaled(F.col("embedding"), factor).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    whole = whole.where(F.col("v").isNotNull())
    n_queries, n_rows = whole.agg(F.count_if("asks"), F.count(F.lit(1))).first()
    spark = rows.sparkSession
    workers = max(2, spark.sparkContext.defaultParallelism)
    query_cells = max(1, -(-n_queries // CELL[0]))
    row_cells = max(1, -(-n_rows // CELL[1]), min(4 * workers, -(-n_rows // most)))
    asked = packed(whole.where("asks").select("id", "v"), most)
    asked = asked.withColumn("row", F.pmod("block", F.lit(query_cells).cast("long"))).withColumn("column", F.explode(cells(row_cells)))
    blocks = packed(whole.select("id", "v"), most).select(*[F.col(c).alias(f"c_{c}") for c in ("block", "ids", "data", "n")])
    place = F.pmod(F.xxhash64("c_block"), F.lit(row_cells).cast("long"))
    blocks = blocks.withColumn("column", place).withColumn("row", F.explode(cells(query_cells)))
    met = asked.join(blocks, ["row", "column"]).select("block", "ids", "data", "n", "c_block", "c_ids", "c_data", "c_n")
    found = met.mapInArrow(searched(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
