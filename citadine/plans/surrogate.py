"""A street network with incidents, by arithmetic on the given tables.

customer is a lattice of 50 columns with a pitch of 100 m, orders are incidents on its nodes, part are points of interest. The same arithmetic is written once
for Spark and once, as common table expressions, for the SQL that results are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGMA, CUTOFF, MIN_LENGTH = 120.0, 360.0, 80.0
LAT0, LON0, METRES = 41.88, -87.63, 111320.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    n = n.withColumn("row", F.floor(F.col("node_id") / 50)).withColumn("col", F.col("node_id") % 50)
    n = n.withColumns({"x": F.col("col") * 100.0, "y": F.col("row") * 100.0, "zone": F.floor(F.col("row") / 5) * 10 + F.floor(F.col("col") / 5)})
    return n.withColumns({"lat": LAT0 + F.col("y") / METRES, "lon": LON0 + F.col("x") / (METRES * F.cos(F.radians(F.lit(LAT0))))})


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("node_id", "col")
    there = n.select(F.col("node_id").alias("v"))
    right = n.where("col < 49").select(F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"), (80 + (F.col("node_id") * 37) % 61).cast("double").alias("length"))
    down = n.select(F.col("node_id").alias("u"), (F.col("node_id") + 50).alias("v"), (80 + (F.col("node_id") * 53 + 11) % 61).cast("double").alias("length"))
    return right.unionByName(down).join(there.hint("merge"), "v", "left_semi").select("u", "v", "length")


def incidents(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("node_id"), F.col("o_orderdate").alias("fecha"), F.date_format("o_orderdate", "yyyy-MM").alias("mes"), F.col("o_orderpriority").alias("tipo"), "o_totalprice", "o_orderstatus")


def counts(spark: SparkSession, d: str) -> DataFrame:
    return incidents(spark, d).groupBy("mes", "node_id").agg(F.count("*").alias("c"))


def zone_edges(spark: SparkSession, d: str) -> DataFrame:
    z = nodes(spark, d).select("node_id", "zone")
    e = edges(spark, d).join(z.withColumnsRenamed({"node_id": "u", "zone": "zu"}), "u").join(z.withColumnsRenamed({"node_id": "v", "zone": "zone"}), "v")
    return e.where("zu = zone").select("zone", "u", "v", "length")


def pois(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("poi_id"),
        ((F.col("p_partkey") * 7919) % 5000).cast("double").alias("x"),
        ((F.col("p_partkey") * 104729) % 3000).cast("double").alias("y"),
        F.col("p_type").alias("category"),
        (2015 + (F.col("p_size") % 8)).alias("year"),
        "p_brand",
        "p_name",
    )


def zone_pois(spark: SparkSession, d: str) -> DataFrame:
    """Points strictly inside a zone's square of 400 m with a margin of 50 m and rounded corners.

    A zone's number gives its square, so each point is held against the nine around it before any join. The join with the zones that have nodes is a merge: a file's size says
    nothing of what an explosion makes of its rows, and must not choose a broadcast."""
    z = nodes(spark, d).select("zone").distinct()
    p = pois(spark, d).withColumns({"zx": F.floor(F.col("x") / 500), "zy": F.floor(F.col("y") / 500)})
    spread = p.withColumn("zx", F.explode(F.sequence(F.col("zx") - 1, F.col("zx") + 1))).withColumn("zy", F.explode(F.sequence(F.col("zy") - 1, F.col("zy") + 1))).where("zx between 0 and 9 and zy >= 0")
    away = lambda a, near: F.greatest(near - F.col(a), F.col(a) - near - 400.0, F.lit(0.0))
    dx, dy = away("x", F.col("zx") * 500.0), away("y", F.col("zy") * 500.0)
    inside = spread.where(dx * dx + dy * dy < 2500.0).select((F.col("zy") * 10 + F.col("zx")).alias("zone"), "poi_id", "category", "year")
    return inside.join(z.hint("merge"), "zone", "left_semi")


#: The same tables for DuckDB; each expression may use those before it.
CTES = {
    "nodes": """SELECT c_custkey AS node_id, c_custkey // 50 AS "row", c_custkey % 50 AS col, (c_custkey % 50) * 100.0::DOUBLE AS x, (c_custkey // 50) * 100.0::DOUBLE AS y,
      ((c_custkey // 50) // 5) * 10 + (c_custkey % 50) // 5 AS zone, 41.88::DOUBLE + (c_custkey // 50) * 100.0::DOUBLE / 111320.0 AS lat,
      -87.63::DOUBLE + (c_custkey % 50) * 100.0::DOUBLE / (111320.0 * cos(radians(41.88))) AS lon FROM customer""",
    "edges": """SELECT a.node_id AS u, b.node_id AS v, CAST(80 + (a.node_id * 37) % 61 AS DOUBLE) AS length FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 1 WHERE a.col < 49
      UNION ALL SELECT a.node_id, b.node_id, CAST(80 + (a.node_id * 53 + 11) % 61 AS DOUBLE) FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 50""",
    "arcs": "SELECT u AS src, v AS dst, length FROM edges UNION ALL SELECT v, u, length FROM edges",
    "incidents": "SELECT o_orderkey AS uid, o_custkey AS node_id, o_orderdate AS fecha, strftime(o_orderdate, '%Y-%m') AS mes, o_orderpriority AS tipo, o_totalprice, o_orderstatus FROM orders",
    "counts": "SELECT mes, node_id, count(*) AS c FROM incidents GROUP BY ALL",
    "k0": "SELECT DISTINCT src, src AS dst, 0.0::DOUBLE AS d FROM arcs",
    **{
        f"k{i}": f"SELECT src, dst, min(d) AS d FROM (SELECT * FROM k{i - 1} UNION ALL SELECT k.src, a.dst, k.d + a.length FROM k{i - 1} k JOIN arcs a ON a.src = k.dst WHERE k.d + a.length <= 360) GROUP BY ALL"
        for i in range(1, 6)
    },
    "kernel": "SELECT * FROM k5",
    "field": "SELECT mes, dst AS node_id, sum(c * exp(-d * d / 28800.0)) AS f FROM counts JOIN kernel ON counts.node_id = kernel.src GROUP BY ALL",
    "zones": "SELECT zone, node_id, x, y FROM nodes",
    "zone_edges": "SELECT a.zone, e.u, e.v, e.length FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v WHERE a.zone = b.zone",
    "pois": """SELECT p_partkey AS poi_id, CAST((p_partkey * 7919) % 5000 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 3000 AS DOUBLE) AS y, p_type AS category, 2015 + p_size % 8 AS year, p_brand, p_name FROM part""",
    "zone_pois": """SELECT zone, poi_id, category, year FROM pois JOIN (SELECT DISTINCT zone, (zone % 10) * 500.0 AS x0, (zone // 10) * 500.0 AS y0 FROM nodes) z
      ON pow(greatest(x0 - x, x - x0 - 400, 0), 2) + pow(greatest(y0 - y, y - y0 - 400, 0), 2) < 2500""",
    "zone_counts": "SELECT zone, mes, sum(c) AS c FROM counts JOIN nodes USING (node_id) GROUP BY ALL",
}


def sql(body: str, *names: str) -> str:
    """``body`` with the given common table expressions and those that they use before it."""
    import re

    needed: set[str] = set()

    def need(text: str) -> None:
        for other in CTES:
            if other not in needed and re.search(rf"\b{other}\b", text):
                needed.add(other)
                need(CTES[other])

    need(body)
    needed.update(names)
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
