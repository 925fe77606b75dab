"""Positions under an order, per group, as 64-bit numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch


def numbered(df: DataFrame, group: list[str], order: list, scratch: Scratch, name: str = "position") -> DataFrame:
    """``df`` with the position (from 0) of each row within its group.  Rows
    are range-sorted by group and order, so a hot group spans many tasks, and
    written; a position is the rows of the group in earlier partitions plus
    the place inside the partition.  A null group is a group; rows equal in
    group and order take neighbouring positions."""
    ordered = scratch.put(df.orderBy(*group, *order).withColumn("_part", F.spark_partition_id())
                          .withColumn("_row", F.monotonically_increasing_id()), "sorted")
    keys = [*group, "_part"]
    runs = ordered.groupBy(*keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    runs = runs.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)], "_off")
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return ordered.join(runs, same).withColumn(name, F.col("_off") + F.col("_row")).drop(*[f"_g{i}" for i in range(len(keys))], "_part", "_row", "_off")
