"""Counts on nodes, the bounded geodesic kernel, and the density field."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine import storage


def node_counts(incidents: DataFrame, by: list[str]) -> DataFrame:
    """Incidents per group and node; unsnapped ones don't count."""
    return incidents.where("node_id is not null").groupBy(*by, "node_id").agg(F.count("*").alias("c"))


def kernel(arcs: DataFrame, cutoff: float, min_length: float, sources: DataFrame | None = None) -> DataFrame:
    """Shortest distances up to ``cutoff``, inclusive: src, dst, d.

    Each round extends all paths by one arc and keeps the shortest; ``min_length`` bounds the number of rounds. Without ``sources``, all nodes
    with an arc are sources. Where there are more than eight rounds, every fourth is written and read again.
    """
    start = sources if sources is not None else arcs.select("src").distinct()
    reach = start.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("d"))
    step = arcs.select(F.col("src").alias("via"), F.col("dst").alias("to"), "length")
    rounds = math.ceil(cutoff / min_length)
    for k in range(rounds):
        further = reach.join(step.hint("merge"), reach.dst == step.via).select("src", F.col("to").alias("dst"), (F.col("d") + F.col("length")).alias("d")).where(F.col("d") <= cutoff)
        reach = reach.unionByName(further).groupBy("src", "dst").agg(F.min("d").alias("d"))
        if k % 4 == 3 and k + 1 < rounds and rounds > 8:
            reach = storage.saved(reach, "reach")
    return reach


def stored_kernel(arcs: DataFrame, cutoff: float, min_length: float) -> DataFrame:
    """The kernel of all nodes, written once for each network and cutoff and read from then on; it doesn't depend on the month, sigma (below the cutoff) or replicate."""
    from citadine.operators import regions

    spark = arcs.sparkSession

    def build() -> DataFrame:
        own = regions.kernel_in_arrays(arcs, cutoff, math.ceil(cutoff / min_length))
        return kernel(arcs, cutoff, min_length) if own is None else own

    return storage.cached(spark, "kernel", {"cutoff": cutoff}, [arcs.select("src", "dst", "length")], build, ["src"])


def density_field(counts: DataFrame, distances: DataFrame, sigma: float, by: list[str]) -> DataFrame:
    """f = sum of counts times exp(-d^2 / 2 sigma^2), for nodes with f > 0. The join is a merge, as in the kernel: files say too little of how many rows they hold to let them choose a broadcast."""
    weight = F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma))
    return counts.withColumnRenamed("node_id", "src").join(distances.hint("merge"), "src").groupBy(*by, F.col("dst").alias("node_id")).agg(F.sum(F.col("c") * weight).alias("f"))


def above_floor(field: DataFrame, ratio: float | str, by: list[str]) -> DataFrame:
    """Nodes at or above a share (a number or a column) of their group's highest value."""
    limit = F.col(ratio) if isinstance(ratio, str) else F.lit(ratio)
    return field.withColumn("top", F.max("f").over(Window.partitionBy(*by))).where(F.col("f") >= limit * F.col("top")).drop("top")


def local_maxima(field: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """Nodes without a neighbour that is higher, or as high with a smaller id; heights to 9 digits."""
    own = field.withColumn("h", F.round("f", 9))
    other = own.select(*by, F.col("node_id").alias("dst"), F.col("h").alias("h2"))
    higher = own.join(arcs.select(F.col("src").alias("node_id"), "dst"), "node_id").join(other, [*by, "dst"])
    higher = higher.where((F.col("h2") > F.col("h")) | ((F.col("h2") == F.col("h")) & (F.col("dst") < F.col("node_id")))).select(*by, "node_id")
    return field.join(higher, [*by, "node_id"], "left_anti")
