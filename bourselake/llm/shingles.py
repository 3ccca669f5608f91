"""Near copies by shingle similarity: SimHash links, verified; then what fingerprints miss.

The rest comes by a prefix filter with positions, pivots for large groups, parity sketches and exact verification.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from bourselake.llm.common import fresh, raw_texts, small_batches, text_of, written
from bourselake.llm.simhash import LOWER, components, fingerprint, links

HOT = 64  # documents under one prefix shingle that are still paired without a pivot
FLUSH = 1 << 18  # shingles a task gathers before it adds them to its counts, or hands rows on
TALLY = 1 << 19  # shingles a task counts at a time
COPIES = 1 << 17  # texts a task remembers, so that a copy of one of them adds no rows


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(LOWER).split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles; fewer words than `size`: one shingle; no word: none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - size + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b - 1], 42) for a, b in zip([0, *ends][:n], ends[min(size, len(words)) - 1:])],
                              dtype=np.uint64))


@F.arrow_udf(LongType())
def text_keys(texts: pa.Array) -> pa.Array:
    """XXH64 of the lower-case words; texts that differ in case or white space alone are one."""
    keys = [xxhash.xxh64_intdigest(b" ".join(words_of(t)), 42) for t in raw_texts(texts)]
    return pa.array(np.array(keys, dtype=np.uint64).view(np.int64))


def marker(size: int):
    """Column function: text to its key (as `text_keys`) and the SimHash of its shingles."""
    @F.arrow_udf("struct<key: bigint, fp: bigint>")
    def marks(texts: pa.Array) -> pa.Array:
        made = [(xxhash.xxh64_intdigest(b" ".join(words_of(t)), 42), fingerprint(t, size)) for t in raw_texts(texts)]
        both = np.array(made, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["key", "fp"])
    return marks


def marked_by(docs: DataFrame, size: int, *columns: str) -> DataFrame:
    return docs.select(*columns, marker(size)(text_of("text")).alias("m")).select(*columns, "m.key", "m.fp")


def flagged(keys: DataFrame, bits: int = 1 << 23):
    """Column function: text to whether its key may be among `keys`, by a bit table of fixed size; never false for one that is."""
    h = keys.select(F.pmod("key", F.lit(bits)).alias("h")).select(F.floor(F.col("h") / 64).cast("int").alias("w"), (F.col("h") % 64).cast("int").alias("b"))
    table = np.zeros(bits // 64, dtype=np.int64)
    for r in h.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).collect():
        table[r["w"]] = r["m"]
    marks = table.view(np.uint64)

    @F.arrow_udf("boolean")
    def among(texts: pa.Array) -> pa.Array:
        keys = [xxhash.xxh64_intdigest(b" ".join(words_of(t)), 42) for t in raw_texts(texts)]
        at = np.array(keys, dtype=np.uint64) & np.uint64(bits - 1)
        return pa.array((marks[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))
    return among


def setter(size: int):
    @F.arrow_udf(ArrayType(LongType()))
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(words_of(t), size).view(np.int64) for t in raw_texts(texts)], pa.list_(pa.int64()))
    return sets


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the elements by their low bits, as words of 64: the bits are a power of two, as many as elements at least.

    The bits in which the sketches of two sets differ are at most the elements that one set alone has.
    """
    bits = max(64, 1 << max(len(found) - 1, 0).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketcher(size: int):
    @F.arrow_udf("struct<n: int, bits: array<bigint>>")
    def sketches(texts: pa.Array) -> pa.Array:
        made = [(len(found), sketch(found)) for found in (shingle_set(words_of(t), size) for t in raw_texts(texts))]
        bits = pa.array([b for _n, b in made], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array([n for n, _b in made], pa.int32()), bits], ["n", "bits"])
    return sketches


def common_shingles(docs: DataFrame, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles and their counts, at most `most`.

    A task counts in a table of bounded size that lets go of the rarest when it is full, so counts may fall short. The table
    decides only which shingles a prefix takes last: whatever it holds, the filter loses no pair.
    """
    def count(batches):
        held, n = [], 0
        seen, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                held.append(shingle_set(words_of(text), size))
                n += len(held[-1])
                if n >= FLUSH:
                    seen, counts = added(seen, counts, held)
                    held, n = [], 0
        seen, counts = added(seen, counts, held)
        often = counts > 1
        yield pa.RecordBatch.from_pydict({"h": seen[often].view(np.int64), "n": counts[often]})

    def added(seen, counts, held):
        new, more = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *held]), return_counts=True)
        at = np.searchsorted(seen, new)
        known = seen[np.minimum(at, max(len(seen) - 1, 0))] == new if len(seen) else np.zeros(len(new), dtype=bool)
        counts[at[known]] += more[known]
        seen, counts = np.insert(seen, at[~known], new[~known]), np.insert(counts, at[~known], more[~known])
        least = 1
        while len(seen) > TALLY:
            kept = counts > least
            seen, counts, least = seen[kept], counts[kept], 2 * least
        return seen, counts

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "h").limit(most).collect()
    hashes = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["n"] for r in rows], dtype=np.int64)[order]


def prefixer(size: int, percent: int, common: tuple[np.ndarray, np.ndarray]):
    """Arrow map: text to rows (t, key, n, pos), the rarest shingles of which one at least is shared with any similar text."""
    hashes, counts = common

    def run(batches):
        out, held, known = [], 0, set()
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                words = words_of(text)
                if not words:
                    continue
                key = np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).view(np.int64)
                if key in known:
                    continue
                if len(known) >= COPIES:
                    known.clear()
                known.add(key)
                found = shingle_set(words, size)
                n = len(found)
                at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
                weight = np.where(hashes[at] == found, counts[at], 0) if len(hashes) else np.zeros(n, dtype=np.int64)
                first = found[np.lexsort((found, weight))[:n - -(-percent * n // 100) + 1]].view(np.int64)
                out.append((first, np.full(len(first), key), np.full(len(first), n, dtype=np.int32), np.arange(len(first), dtype=np.int32)))
                held += len(first)
                if held >= FLUSH:
                    yield closed(out)
                    out, held = [], 0
        if out:
            yield closed(out)

    def closed(out):
        return pa.RecordBatch.from_pydict(dict(zip(("t", "key", "n", "pos"), map(np.concatenate, zip(*out)))))
    return run


def may_reach(a, b, percent: int) -> Column:
    """Whether two texts (n, pos) can be similar whose first common shingle is this one: by their sizes, and by what follows it."""
    na, nb, pa_, pb = (s[c].cast("long") for c in ("n", "pos") for s in (a, b))
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & (F.least(na - pa_, nb - pb) * (100 + percent) >= percent * (na + nb)))


def side(name: str) -> dict[str, Column]:
    return {c: F.col(f"{name}.{c}") for c in ("n", "pos")}


def met(rows: DataFrame, percent: int, hot: int) -> DataFrame:
    """The rows under a shingle of several texts, with `members`, the number of these texts.

    `partners` are the keys of the earlier texts that the row's may reach, where there are at most `hot` texts; otherwise it
    is empty and `pivot` is the text with the fewest rarer shingles. Rows without any partner are left out. One exchange by
    shingle serves the removal of copies, the counts, the pivots and the pairs.
    """
    one = rows.repartition("t").distinct()
    group = Window.partitionBy("t").orderBy("key")
    whole, before = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), group.rowsBetween(Window.unboundedPreceding, -1)
    held = one.withColumn("members", F.count(F.lit(1)).over(whole)).withColumn("pivot", F.min(F.struct("pos", "key", "n")).over(whole)).where("members > 1")
    row = F.struct("key", "n", "pos")
    held = held.withColumn("partners", F.collect_list(F.when(F.col("members") <= hot, row)).over(before))
    own = {"n": F.col("n"), "pos": F.col("pos")}
    reached = F.transform(F.filter("partners", lambda y: may_reach(own, y, percent)), lambda y: y["key"])
    return held.withColumn("partners", reached).where((F.col("members") > hot) | (F.size("partners") > 0))


def close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) less those whose sketches (key, n, bits) show that they are not similar.

    Of two widths of sketches the larger is folded to the other; where it is more than twice as wide the pair stays.
    """
    def folded(x: Column, y: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        halves = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) == 2 * F.size(y), halves).otherwise(x)

    left, right = (sketches.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    held = pairs.join(left, "a").join(right, "b")
    x, y = F.col("bits_a"), F.col("bits_b")
    differing = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda acc, n: acc + n)
    differing = F.when(F.greatest(F.size(x), F.size(y)) <= 2 * F.least(F.size(x), F.size(y)), differing).otherwise(0)
    own = (F.col("n_a") + F.col("n_b")).cast("long")
    return held.where(differing * (100 + percent) <= own * (100 - percent)).select("a", "b")


def similar(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of text keys whose shingle sets have at least this Jaccard similarity.

    Whole sets travel only for the pairs that their sketches leave.
    """
    pairs = written(close(pairs, sketches, percent))
    chosen = of_keys(docs, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    one = chosen.groupBy("key").agg(F.min("text").alias("text"))
    sets = written(one.select("key", setter(size)(F.col("text")).alias("set")))
    left, right = (sets.select(F.col("key").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    held = pairs.join(left, "a").join(right, "b")
    return held.where(both * (100 + percent) >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the texts whose key is among `keys`; texts that surely are not do not meet the join."""
    keys = written(keys)
    return docs.where(flagged(keys)(F.col("text"))).select(text_keys(F.col("text")).alias("key"), "text").join(keys, "key", "left_semi")


def pairs_of(rows: DataFrame, others: DataFrame, percent: int, more: Column) -> DataFrame:
    found = rows.alias("x").join(others.alias("y"), F.col("x.t") == F.col("y.t")).where(may_reach(side("x"), side("y"), percent) & more)
    return ordered(found, F.col("x.key"), F.col("y.key")).distinct()


def ordered(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def fingerprint_pairs(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of text keys that SimHash brings together, from rows (key, fp): the components are those of all fingerprints within two bits.

    The texts of one fingerprint are tied to the one with the smallest key, which stands for them in the links between fingerprints.
    """
    prints = written(marks.select("key", "fp").distinct())
    firsts = written(prints.groupBy("fp").agg(F.min("key").alias("first")))
    same = prints.join(firsts, "fp").where("key != first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    left, right = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"key_{c}")) for c in "ab")
    near = links(firsts.select("fp")).join(left, "a").join(right, "b")
    return same.unionByName(ordered(near, F.col("key_a"), F.col("key_b"))).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not yet in one component of `roots` (node, root)."""
    left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    held = pairs.join(left, "a", "left").join(right, "b", "left")
    return held.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def similar_links(docs: DataFrame, size: int = 5, percent: int = 80, most: int = 1 << 18, hot: int = HOT, marks: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of text keys whose components are those of all pairs of texts with Jaccard similarity `percent` / 100 or more.

    First come the pairs that SimHash links, verified. Fingerprints miss similar texts, so pairs are then made from prefixes:
    similar texts share a shingle of theirs, so they meet under one. Of these pairs, those not yet in one component whose
    sketches allow it are verified on whole sets. Under a shingle with more than `hot` texts, all are compared with one pivot,
    the text with the fewest rarer shingles; then only pairs that are not yet in one component are made, of which one is
    outside that of the pivot. None is left out. `marks` are the rows (key, fp) of `marked_by`, if they are there already.
    """
    near = written(fingerprint_pairs(marked_by(docs, size) if marks is None else marks))
    docs = docs.select(text_of("text").alias("text"))
    rows = docs.mapInArrow(prefixer(size, percent, common_shingles(docs, size, most)), "t long, key long, n int, pos int")
    rows = written(met(rows, percent, hot))
    many = rows.where(F.col("members") > hot).drop("partners")
    few = ordered(rows.select("key", F.explode("partners").alias("other")), F.col("key"), F.col("other"))
    to_pivot = many.where((F.col("key") != F.col("pivot.key")) & may_reach({"n": F.col("n"), "pos": F.col("pos")}, side("pivot"), percent))
    first = written(few.unionByName(ordered(to_pivot, F.col("key"), F.col("pivot.key"))).distinct())
    ends = first.unionByName(near).select(F.explode(F.array("a", "b")).alias("key"))
    named = written(ends.unionByName(many.select("key")).distinct())
    drawn = docs.where(flagged(named)(F.col("text"))).select(text_keys(F.col("text")).alias("key"), sketcher(size)(F.col("text")).alias("s"))
    sketches = written(drawn.join(named, "key", "left_semi").groupBy("key").agg(F.min("s").alias("s")).select("key", "s.*"))
    linked = written(similar(docs, near, sketches, size, percent))
    edges = written(linked.unionByName(similar(docs, apart(first, components(linked)), sketches, size, percent)))
    if many.isEmpty():
        return edges
    roots = components(edges).withColumnRenamed("node", "key")
    rooted = written(many.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    main = rooted.where(F.col("key") == F.col("pivot.key")).select("t", F.col("root").alias("main"))
    outside = rooted.join(main, "t").where("root != main")
    rest = written(pairs_of(outside, rooted, percent, F.col("x.root") != F.col("y.root")))
    return edges.unionByName(similar(docs, rest, sketches, size, percent))


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """(key, root) for the keys of texts that have a similar text of another key."""
    return components(similar_links(docs, size, percent, **options)).withColumnRenamed("node", "key")


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of `docs` less near copies: of each component the row with the smallest doc_id (null last) stays.

    Texts with the same words are copies, texts without a word too. Of repeated rows with that id and those words one stays,
    the one with the smallest text. Null text has no words. An empty table gives no rows; other columns pass through, whatever
    their names.
    """
    small_batches(docs.sparkSession)
    chosen_id, chosen_key, copies, own, likely, whole = fresh(docs, "_chosen", "_key", "_rows", "_own", "_maybe", "_row")
    marked = written(marked_by(docs, size, "doc_id"))
    roots = written(similar_components(docs, size, percent, marks=marked, **options))
    nodes = marked.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("k"))
    nodes = nodes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    firsts = nodes.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias(chosen_id), F.col("k.key").alias(chosen_key))
    same = (marked["key"] == firsts[chosen_key]) & marked["doc_id"].eqNullSafe(firsts[chosen_id])
    chosen = written(marked.join(firsts, same).groupBy(chosen_id, chosen_key).agg(F.count(F.lit(1)).alias(copies)))
    # only texts of a key with a row that goes, or maybe goes, meet a join
    alone = chosen.where(F.col(copies) == 1).select(F.col(chosen_key).alias("key"))
    touched = written(marked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(alone.withColumn("one", F.lit(1)), "key", "left").where(
        "n > 1 or one is null").select("key"))
    split = docs.withColumn(likely, flagged(touched)(text_of("text")))
    kept = split.where(F.col(likely)).drop(likely).withColumn(own, text_keys(text_of("text")))
    kept = kept.join(chosen, (kept[own] == chosen[chosen_key]) & kept["doc_id"].eqNullSafe(chosen[chosen_id]))
    single = kept.where(F.col(copies) == 1).select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    several = kept.where(F.col(copies) > 1).groupBy(chosen_id, own).agg(F.min_by(row, text_of("text")).alias(whole)).select(f"{whole}.*")
    rest = split.where(~F.col(likely)).drop(likely)
    return rest.unionByName(single).unionByName(several)
