"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from hindcast.session import shared_dir

# Arrow batches stay small in bytes whatever the texts' lengths.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


class Workspace:
    """One run's folder; tables written there cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.base = spark, shared_dir(spark, purpose)

    def saved(self, df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
        """With ``group_bytes`` row groups end at about that size. Spark reads 4,096 rows at once but none of the
        next group, so this bounds what a reader of long rows holds."""
        path, writer = f"{self.base}/{name}", df.write.mode("overwrite")
        if group_bytes is not None:
            writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1})
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def blocks(spark: SparkSession, least: int = 64) -> int:
    """A power of two of hash blocks, about four for each shuffle partition, so
    that a block stays as small as the cluster's partitions are."""
    return 1 << math.ceil(math.log2(max(least, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def bounded_arrow(spark: SparkSession) -> SparkSession:
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark
