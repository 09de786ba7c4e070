"""Session settings the operators are designed around."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

MIB = 1 << 20

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; cluster sizing stays as the session has it."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shuffle_partitions(input_bytes: int, target_bytes: int = 128 * MIB, minimum: int = 8) -> int:
    """Shuffle partitions so that each holds about ``target_bytes``."""
    return max(minimum, -(-input_bytes // target_bytes))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` or the context's own
    checkpoint setting names. Only a local session without either, as in tests,
    is given one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hindcast-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
