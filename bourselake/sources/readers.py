"""File sources: dispatch on suffix, tolerant headers, envelopes, and loud failures."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingSource(LookupError):
    """A required source is not registered or not delivered; there is no silent fallback."""


class SourceRegistry:
    """Named loaders; asking for an unknown or undelivered one fails."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[], DataFrame]] = {}
        self._reasons: dict[str, str] = {}

    def add(self, name: str, loader: Callable[[], DataFrame]) -> None:
        self._loaders[name] = loader

    def declare_missing(self, name: str, reason: str) -> None:
        self._reasons[name] = reason

    def load(self, name: str) -> DataFrame:
        if name not in self._loaders:
            raise MissingSource(f"{name}: {self._reasons.get(name, 'not registered')}")
        return self._loaders[name]()


def read_optional_table(spark: SparkSession, path: str | None) -> DataFrame | None:
    """CSV or Parquet by suffix; no path means the module that needs it is skipped."""
    if path is None:
        return None
    lowered = path.lower()
    if lowered.endswith(".csv"):
        return spark.read.csv(path, header=True)
    if lowered.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported table format: {path}")


def read_constituents(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV per sector with a `Symbol` column in any case or spacing; sector = file name."""
    raw = spark.read.csv(f"{folder}/*.csv", header=True).withColumn(
        "_sector", F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), "%20", " "),
                                    r"\.csv$", ""))
    names = [c for c in raw.columns if c.strip().lower() == "symbol"]
    if not names:
        raise ValueError("constituent files need a Symbol column")
    return clean_membership(raw.select(F.col("_sector").alias("sector"),
                                       F.col(f"`{names[0]}`").alias("symbol")))


def clean_membership(df: DataFrame) -> DataFrame:
    """Trimmed upper-case symbols, blanks dropped, each pair once."""
    symbol = F.upper(F.trim("symbol"))
    return (df.select(F.trim("sector").alias("sector"), symbol.alias("symbol"))
            .filter(F.length("symbol") > 0).distinct())


def read_news_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV rows, or JSON with the rows at the top level or under rows, data or news."""
    if path.lower().endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema)
    envelope = ", ".join(f"{key} array<struct<{_as_struct(schema)}>>"
                         for key in ("rows", "data", "news"))
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{_as_struct(schema)}>>")
    wrapped = F.from_json("value", envelope)
    return text.select(F.inline(F.coalesce(
        wrapped["rows"], wrapped["data"], wrapped["news"], bare)))


def _as_struct(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in
                     (field.split() for field in schema.split(",")))


def rename_and_cast(df: DataFrame, mapping: Mapping[str, str], numeric: tuple[str, ...] = (),
                    dates: Mapping[str, str] | None = None) -> DataFrame:
    """Adapter: vendor names to ours, unparsable numbers and dates to null."""
    df = df.withColumnsRenamed(dict(mapping))
    for name in numeric:
        df = df.withColumn(name, F.regexp_replace(
            F.col(name).cast("string"), ",", "").try_cast("double"))
    for name, pattern in (dates or {}).items():
        df = df.withColumn(name, F.try_to_date(F.col(name).cast("string"), pattern))
    return df
