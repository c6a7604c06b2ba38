"""Session-level helpers: where cut lineage goes, and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a side may hold and still be sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a scratch one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spanveil-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as Parquet in the shared folder, packed, read from there."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes of text.

    Reads no more rows than it must to tell.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    seen = df.limit(rows + 1).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(row)), F.lit(0)).alias("bytes")
    ).first()
    return seen["n"] <= rows and seen["bytes"] <= size
