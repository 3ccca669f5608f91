"""Helpers shared by the text operators."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselake.session import shared_dir

#: White space between words, as a regular expression class body.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to the Python workers a few MB at a time: a batch lies in memory four times, in and out on both sides.

    Sizes that the session has set itself stay.
    """
    for key, usual, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        made.append(name)
        taken.add(name)
    return made


def text_of(name: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pieces(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts with at most `size` bytes together, one text at least: what a worker holds as objects."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        n = n or 0
        if held and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if len(texts) > start:
        yield start, len(texts)


def raw_texts(texts: pa.Array) -> Iterator[bytes | None]:
    """The texts as bytes, made piece by piece."""
    for low, high in pieces(texts):
        yield from texts.slice(low, high - low).cast(pa.binary()).to_pylist()


def words_of(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(text, f"[{BLANK}]+"), "")


def bucket5(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: a lambda variable, since Spark repeats shared parts inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(numbers: Column, block: int = 128) -> Column:
    """Running sums of an integer array, itself included, in blocks so that long arrays are not copied per element."""
    def running(array: Column, finish) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("total"))
        return F.aggregate(array, start, lambda acc, x: F.struct(
            F.concat(acc["done"], F.array(finish(acc, x))).alias("done"), (acc["total"] + x).alias("total")),
            lambda acc: acc["done"])

    def joined(within: Column) -> Column:
        bases = running(F.transform(within, lambda part: F.element_at(part, -1)), lambda acc, x: acc["total"])
        return F.flatten(F.zip_with(within, bases, lambda part, base: F.transform(part, lambda x: x + base)))

    def summed(array: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / block).cast("int")),
                             lambda b: running(F.slice(array, b * block + 1, F.lit(block)), lambda acc, x: acc["total"] + x))
        return F.when(F.size(array) > 0, let(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return let(F.transform(numbers, lambda x: x.cast("int")), summed)


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,value>>, code points, end exclusive.

    Positions are running sums over what lies between matches and the matches themselves.
    """
    def placed(found: Column) -> Column:
        steps = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g))
        return F.zip_with(found, prefix_sums(steps), lambda m, end: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(no_spans()))


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def span_text(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def tagged(kinds, column, make) -> Column:
    """One array over the span arrays of several kinds: make(kind, position of the kind, span) per span."""
    def one(n: int, kind: str) -> Column:
        return F.transform(column(kind), lambda s: make(kind, n, s))
    return F.concat(*[one(n, kind) for n, kind in enumerate(kinds)])
