"""Places of rows in an order, found by many tasks even where all rows belong to one group.

Rows are dealt by ranges of (group, order), so each task sorts one range; what comes before a
range is the sum of the ranges before it, a few numbers a group. A window by group would sort
a whole group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settle import settle


def cumulative(rows: DataFrame, keys: tuple[str, ...], order: list[str | Column], weight: str | None = None, name: str = "_before", whole: str = "_whole") -> DataFrame:
    """Add the total weight of a group's earlier rows, and of all its rows; without a weight rows are counted.

    Rows that are equal in the order come in any order among each other, but in one range. The
    ranges are settled, as their bounds are drawn from a sample. Without keys all rows are one group.
    """
    sizes = F.lit(1).cast("long") if weight is None else F.col(weight)
    ranged = settle(rows.withColumn("_size", sizes).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_range").agg(F.sum("_size").alias("n"))
    # one entry a range
    listed = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_range", "n"))).alias("l"), F.sum("n").alias(whole))
    total = F.aggregate(F.slice("l", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    offsets = listed.select(*keys, whole, "l", F.posexplode("l").alias("i", "p")).select(*keys, whole, F.col("p")["_range"].alias("_range"), total.alias("_offset"))
    earlier = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn(name, F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    return placed.join(offsets, [*keys, "_range"]).withColumn(name, F.col(name) + F.col("_offset")).drop("_size", "_range", "_offset")
