"""Running values over long ordered groups, one bounded slice at a time.

A window partitioned by device puts a busy device's whole history in one task.
Here the group is cut into slices of the ordering value. The slices are first
aggregated (map-side, so a hot group shrinks before it moves), a window over
those few slice rows gives each slice the value carried in from its
predecessors, and that value enters the slice as one extra seed row. No window
ever sees more than one slice of rows or one row per slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SEED = "_seed"


def running_max(df: DataFrame, keys: list[str], slice_col: str, order: list[str],
                value: str, out: str) -> DataFrame:
    """``max(value)`` over each row and all rows before it in ``keys``.

    ``slice_col`` must not decrease along ``order``.
    """
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    upto = (Window.partitionBy(*keys, slice_col)
            .orderBy(F.col(SEED).desc(), *order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seeds = (df.groupBy(*keys, slice_col).agg(F.max(value).alias(value))
             .withColumn(value, F.max(value).over(before))
             .filter(F.col(value).isNotNull())
             .withColumn(SEED, F.lit(True)))
    return (df.withColumn(SEED, F.lit(False))
            .unionByName(seeds, allowMissingColumns=True)
            .withColumn(out, F.max(value).over(upto))
            .filter(~F.col(SEED)).drop(SEED))

