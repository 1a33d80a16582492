"""Street networks: simple graphs, road classes, induced edges and snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine.functions.spatial import cell, haversine, segment_distance


def undirected(edges: DataFrame) -> DataFrame:
    """One edge u < v for each pair, the shortest of parallel ones; loops go."""
    length = F.coalesce("length", F.lit(0.0))
    return edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(length).alias("length"))


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, length in both directions."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "length").unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "length"))


def folded_class(tags: Column, ranks: dict[str, int], classes: dict[str, str], default: str) -> Column:
    """The highest class among an edge's tags (rank 0 is highest); tags without a class don't count."""
    rank = F.create_map(*[x for tag, c in classes.items() for x in (F.lit(tag), F.lit(ranks[c]))])
    best = F.array_min(F.filter(F.transform(tags, lambda t: F.element_at(rank, t)), lambda r: r.isNotNull()))
    name = F.create_map(*[x for c, r in ranks.items() for x in (F.lit(r), F.lit(c))])
    return F.coalesce(F.element_at(name, best), F.lit(default))


def induced_edges(edges: DataFrame, members: DataFrame, group: list[str]) -> DataFrame:
    """Edges with both ends in the same group; ``members`` has the group's columns and node_id. The joins are merges, so neither edges nor members are broadcast."""
    a = members.select(*group, F.col("node_id").alias("u"))
    b = members.select(*group, F.col("node_id").alias("v"))
    return edges.join(a.hint("merge"), "u").join(b.hint("merge"), [*group, "v"])


def snapped(points: DataFrame, nodes: DataFrame, edges: DataFrame, key: str, max_distance: float = 200.0, bound: float | None = None) -> DataFrame:
    """The nearest edge of each point and its nearer end, null beyond ``max_distance``.

    Edges are dealt to the grid cells that they come within the distance of, points to their own cell, so the join is on cells and only compares
    neighbours. Points are (key, lat, lon, x, y), nodes (node_id, lat, lon, x, y), edges (u, v); ties go to the smaller (u, v), and to u.
    """
    side = bound or max_distance
    end = lambda p: nodes.select(F.col("node_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("lat", "lon", "x", "y")])
    segments = edges.select("u", "v").join(end("u"), "u").join(end("v"), "v")
    span = lambda a: F.sequence(cell(F.least(f"u_{a}", f"v_{a}") - max_distance, side), cell(F.greatest(f"u_{a}", f"v_{a}") + max_distance, side))
    dealt = segments.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    placed = points.withColumn("cx", cell(F.col("x"), side)).withColumn("cy", cell(F.col("y"), side))
    near = placed.join(dealt, ["cx", "cy"]).withColumn("dist_edge", segment_distance(*[F.col(c) for c in ("x", "y", "u_x", "u_y", "v_x", "v_y")]))
    du, dv = (haversine(F.col("lat"), F.col("lon"), F.col(f"{p}_lat"), F.col(f"{p}_lon")) for p in "uv")
    best = near.where(F.col("dist_edge") <= max_distance).groupBy(key).agg(
        F.min(F.struct(F.round("dist_edge", 6).alias("dist_edge"), "u", "v", F.when(du <= dv, F.col("u")).otherwise(F.col("v")).alias("node_id"), F.least(du, dv).alias("dist_node"))).alias("best")
    )
    return points.select(key).join(best, key, "left").select(key, "best.u", "best.v", "best.node_id", "best.dist_edge", "best.dist_node")


def snap_summary(snaps: DataFrame) -> DataFrame:
    at = F.percentile("dist_edge", F.array(F.lit(0.5), F.lit(0.95)))
    return snaps.agg(F.count("node_id").alias("snapped"), F.count("*").alias("total"), at[0].alias("median_m"), at[1].alias("p95_m"), F.max("dist_edge").alias("max_m"), F.count_distinct("node_id").alias("nodes"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
