"""Cutting lineage and bounding broadcasts, in ways that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The most that :func:`small` broadcasts, by default.
BROADCAST_BYTES = 64 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is absent and the master is local (tests, a laptop) a temporary folder is made.
    """
    context = spark.sparkContext
    if (known := context.getCheckpointDir()) is not None:
        return known
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that later stages start from files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as compressed Parquet, where :func:`cut` writes its rows as they are in memory."""
    folder = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows have at most ``max_bytes``; else unchanged, to be shuffled.

    ``df`` should come from :func:`cut` or a narrow scan: its rows are counted and measured, strings and binaries by their
    lengths, other values by eight bytes each.
    """
    size = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif kind.startswith(("array", "map")):
            size = size + 8 * F.coalesce(F.size(F.col(name)), F.lit(0))
    total = df.agg(F.sum(size.cast("long"))).first()[0]
    return F.broadcast(df) if (total or 0) <= max_bytes else df
