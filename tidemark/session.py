"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

# Adaptive execution picks partition counts and splits skewed joins at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor can reach.

    A temporary folder stands in for it only in local mode with nothing set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Run ``df`` once and read the result back from reliable storage.

    Used where several jobs read the same expensive intermediate table. The files are in the shared folder, so
    they outlive any executor.
    """
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """About how much memory a row takes: eight bytes a number, and the text of anything else."""
    width = F.lit(16)
    for field in df.schema.fields:
        simple = isinstance(field.dataType, (NumericType, BooleanType, DateType, TimestampType))
        width = width + (F.lit(8) if simple else F.coalesce(F.octet_length(F.col(f"`{field.name}`").cast("string")), F.lit(0)) + 16)
    return width.cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes; the count stops at the limit."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcasting when it is small; a larger one is left to a shuffled join.

    Meant for narrow, already written tables, where counting is cheap.
    """
    return F.broadcast(df) if is_small(df, rows, size) else df
