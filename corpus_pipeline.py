"""A corpus pipeline: each stage works on what the one before kept, written as Parquet in the shared folder in between."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourselake.llm import bpe, decontam, secret_scan, shingles, toxicity
from bourselake.llm.common import table, text_of, written
from bourselake.llm.queries import tokenizer_files
from bourselake.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shaped(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    ship(spark)
    score = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return shaped(docs.where(score["score"] < 0.5))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) stays, that with the smallest id.

    SimHash links come first, as in op3, and are verified; pairs that fingerprints miss are found by their rarest shingles.
    """
    ship(spark)
    return shingles.deduplicated(shaped(docs), size=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship(spark)
    marked = decontam.with_matches(shaped(docs), table(spark, sf_dir, "benchmark"), "_found")
    return shaped(marked.where(F.size("_found.hits") == 0))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes `<SECRET>`; all documents stay, and `n_chars` follows the text."""
    ship(spark)
    found = secret_scan.masked(secret_scan.secrets(shaped(docs)))
    return shaped(found.withColumn("text", F.col("_clean")).withColumn("n_chars", F.length(text_of("text")).cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    ship(spark)
    return bpe.bpe(shaped(docs), **tokenizer_files())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("decontamination", drop_leaks),
                                   ("secrets", mask_secrets), ("bpe", encode)]
#: No stage but the last filter could be said in SQL: the first needs a fitted model.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
