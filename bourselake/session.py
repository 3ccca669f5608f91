"""Session settings and the lineage cut used by iterative operators."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "bourselake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # windows cost CPU, not bytes: do not fold small shuffles into one task
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session (tests, laptop) may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that a lost executor cannot lose the result."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(os.path.join(shared_dir(spark), "checkpoints"))
    return df.checkpoint(eager=True)


def sized(df: DataFrame) -> DataFrame:
    """A summary written to the shared folder and read back: the planner sees its size.

    Of an aggregate the planner only knows the size of its input, and sorts both sides of a join by the key; a small
    summary is sent to the rows, a large one is joined as before.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"sized-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per context, so that UDFs load wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_bourselake_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "bourselake.zip")
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    context._bourselake_shipped = True
