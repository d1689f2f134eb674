"""Connected components of a table of links, by alternating large-star and small-star steps.

A large-star step links every larger neighbour of a node to the smallest of the node and
its neighbours, a small-star step does so for the smaller neighbours and the node. Both
keep connectivity and shorten paths; the links settle as stars around the smallest node of
each component after about a logarithmic number of rounds. Each step is an aggregation
with partial sums and an equi-join, whose hot keys Spark can split. The rounds end when one
changes no link; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link to another node; root is the component's smallest node.

    Links with a null end and loops say nothing and are left out, so a node that has only
    those has no row; repeated links count once. No links give no rows.
    """
    x, y = F.col(a), F.col(b)
    stars = storage.settle(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    while True:
        next_stars = storage.settle(_small_star(_large_star(stars)))
        # both tables hold distinct links, so they are equal if none of the next ones is new and there are as many
        done = next_stars.count() == stars.count() and next_stars.join(stars, ["u", "v"], "left_anti").isEmpty()
        stars = next_stars
        if done:
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("n")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    other = stars.join(least, F.col("u") == F.col("n")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return other.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
