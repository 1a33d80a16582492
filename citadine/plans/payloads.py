"""Joins that put results together, and descriptors beside the shape."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine.operators import embedding, network, paths
from citadine.plans.contrasts import track_metrics
from citadine.plans.features import LQ, descriptors, quotients, zone_arcs
from citadine.plans.registry import query
from citadine.plans.surrogate import counts, edges, nodes, pois, sql, table, zone_edges

MET = "tm AS (SELECT zone, count(DISTINCT mes) / (SELECT count(DISTINCT mes) FROM counts) AS frequency FROM (SELECT zone, mes FROM counts JOIN nodes USING (node_id) GROUP BY zone, mes HAVING sum(c) >= 4) GROUP BY zone), th AS (SELECT quantile_cont(frequency, 1.0 / 3) AS lo, quantile_cont(frequency, 2.0 / 3) AS hi FROM tm)"


@query("poi_contrast", sql(f"WITH {LQ}, {MET} SELECT category, round(coalesce(avg(lq) FILTER (frequency >= hi), 0), 6) AS persistent, round(coalesce(avg(lq) FILTER (frequency <= lo), 0), 6) AS episodic FROM lq JOIN tm USING (zone), th GROUP BY category"))
def poi_contrast(spark, d):
    """Location quotients of persistent and episodic zones by category."""
    m = track_metrics(spark, d).select("zone", "frequency")
    at = m.agg(F.percentile("frequency", F.lit(1 / 3)).alias("lo"), F.percentile("frequency", F.lit(2 / 3)).alias("hi"))
    rows = quotients(spark, d).join(m, "zone").crossJoin(F.broadcast(at))
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col("lq"))), F.lit(0.0)), 6)
    return rows.groupBy("category").agg(mean(F.col("frequency") >= F.col("hi")).alias("persistent"), mean(F.col("frequency") <= F.col("lo")).alias("episodic"))


@query("intersections_per_km", sql("WITH deg AS (SELECT zone, node_id, count(*) AS deg FROM (SELECT zone, u AS node_id FROM zone_edges UNION ALL SELECT zone, v FROM zone_edges) GROUP BY ALL), l AS (SELECT zone, sum(length) / 1000 AS km FROM zone_edges GROUP BY zone) SELECT l.zone, round(coalesce(count(*) FILTER (deg >= 3), 0) / any_value(km), 6) AS per_km FROM l LEFT JOIN deg USING (zone) GROUP BY l.zone"))
def intersections_per_km(spark, d):
    e = zone_edges(spark, d)
    ends = e.select("zone", F.col("u").alias("node_id")).unionByName(e.select("zone", F.col("v").alias("node_id")))
    crossings = ends.groupBy("zone", "node_id").agg(F.count("*").alias("deg")).groupBy("zone").agg(F.count_if(F.col("deg") >= 3).alias("n"))
    return e.groupBy("zone").agg((F.sum("length") / 1000).alias("km")).join(crossings, "zone", "left").select("zone", F.round(F.coalesce("n", F.lit(0)) / F.col("km"), 6).alias("per_km"))


@query("edge_class_lookup", sql("WITH c AS (SELECT least(u, v) AS a, greatest(u, v) AS b, arg_min(road, length) AS road FROM (SELECT u, v, length, CASE WHEN u % 5 = 0 THEN 'avenue' ELSE 'lane' END AS road FROM edges WHERE u % 3 <> 0) GROUP BY ALL) SELECT e.u, e.v, coalesce(c.road, 'street') AS road FROM edges e LEFT JOIN c ON c.a = least(e.u, e.v) AND c.b = greatest(e.u, e.v)"))
def edge_class_lookup(spark, d):
    known = edges(spark, d).where("u % 3 <> 0").withColumn("road", F.when(F.col("u") % 5 == 0, "avenue").otherwise("lane"))
    shortest = known.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min_by("road", "length").alias("road"))
    return edges(spark, d).withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}).join(shortest, ["a", "b"], "left").select("u", "v", F.coalesce("road", F.lit("street")).alias("road"))


@query("union_keep_first", "SELECT k, arg_min(src, ord) AS src FROM (SELECT p_partkey AS k, 'a' AS src, 1 AS ord FROM part WHERE p_size <= 30 UNION ALL SELECT p_partkey, 'b', 2 FROM part WHERE p_size >= 20) GROUP BY k")
def union_keep_first(spark, d):
    p = table(spark, d, "part")
    one = p.where("p_size <= 30").select(F.col("p_partkey").alias("k"), F.lit("a").alias("src"), F.lit(1).alias("ord"))
    two = p.where("p_size >= 20").select(F.col("p_partkey").alias("k"), F.lit("b").alias("src"), F.lit(2).alias("ord"))
    return one.unionByName(two).groupBy("k").agg(F.min_by("src", "ord").alias("src"))


@query("payload_join", sql("WITH zc AS (SELECT zone, sum(c) AS crimes FROM counts JOIN nodes USING (node_id) GROUP BY zone), zp AS (SELECT zone, count(*) AS pois FROM zone_pois GROUP BY zone) SELECT z.zone, coalesce(crimes, 0)::BIGINT AS crimes, coalesce(pois, 0) AS pois FROM (SELECT DISTINCT zone FROM nodes) z LEFT JOIN zc USING (zone) LEFT JOIN zp USING (zone)"))
def payload_join(spark, d):
    from citadine.plans.surrogate import zone_pois

    z = nodes(spark, d).select("zone").distinct()
    crimes = counts(spark, d).join(nodes(spark, d).select("node_id", "zone"), "node_id").groupBy("zone").agg(F.sum("c").alias("crimes"))
    around = zone_pois(spark, d).groupBy("zone").agg(F.count("*").alias("pois"))
    return z.join(crimes, "zone", "left").join(around, "zone", "left").fillna(0)


@query("yearly_centroids", "WITH w AS (SELECT p_brand AS way, 2015 + p_size % 8 AS year, ((p_partkey * 7919) % 5000)::DOUBLE AS x, ((p_partkey * 104729) % 3000)::DOUBLE AS y FROM part) SELECT way, year, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM w GROUP BY ALL")
def yearly_centroids(spark, d):
    return pois(spark, d).groupBy(F.col("p_brand").alias("way"), "year").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query("archetypes", sql("WITH zc AS (SELECT zone, sum(c) AS crimes, count(DISTINCT mes) AS months FROM counts JOIN nodes USING (node_id) GROUP BY zone) SELECT zone, crimes::BIGINT AS crimes, CASE WHEN months >= 5 THEN 'recurrent' ELSE 'rare' END AS kind FROM zc QUALIFY row_number() OVER (PARTITION BY months >= 5 ORDER BY crimes DESC, zone) = 1"))
def archetypes(spark, d):
    """The zone with most incidents among the recurrent ones, and among the others."""
    z = counts(spark, d).join(nodes(spark, d).select("node_id", "zone"), "node_id").groupBy("zone").agg(F.sum("c").alias("crimes"), F.count_distinct("mes").alias("months"))
    z = z.withColumn("kind", F.when(F.col("months") >= 5, "recurrent").otherwise("rare"))
    return network.first_by(z, ["kind"], [F.desc("crimes"), F.col("zone")]).select("zone", "crimes", "kind")


@query("multi_month_counts", sql("SELECT k AS months, count(*) AS zones FROM (SELECT zone, count(DISTINCT mes) AS k FROM counts JOIN nodes USING (node_id) GROUP BY zone) GROUP BY k"))
def multi_month_counts(spark, d):
    z = counts(spark, d).join(nodes(spark, d).select("node_id", "zone"), "node_id").groupBy("zone").agg(F.count_distinct("mes").alias("months"))
    return z.groupBy("months").agg(F.count("*").alias("zones"))


@query("contrast_order", sql("WITH g AS (SELECT o_orderpriority AS tipo, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O') AS delta FROM orders GROUP BY ALL) SELECT tipo, round(delta, 4) AS delta, row_number() OVER (ORDER BY abs(delta) DESC, tipo) AS rank FROM g"))
def contrast_order(spark, d):
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tipo")).agg((mean("F") - mean("O")).alias("delta"))
    return g.select("tipo", F.round("delta", 4).alias("delta"), F.row_number().over(Window.orderBy(F.desc(F.abs("delta")), "tipo")).alias("rank"))  # one row per category


@query("zone_centrality")
def zone_centrality(spark, d):
    return paths.centrality(nodes(spark, d).select("zone", "node_id"), zone_arcs(spark, d), "zone")


@query("subnetwork")
def subnetwork(spark, d):
    return paths.crop(network.both_ways(edges(spark, d)).select("src", "dst"), 0, 60)


@query("similar_zones")
def similar_zones(spark, d):
    """Zones alike in shape alone: standardised descriptors, five nearest by cosine. No count reaches the vectors."""
    s = descriptors(spark, d)
    names = [c for c in s.columns if c != "zone"]
    stats = s.agg(*[x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    z = s.crossJoin(F.broadcast(stats)).select("zone", F.array(*[F.when(F.col(f"s_{c}") > 1e-12, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in names]).alias("vector"))
    return embedding.nearest(z, "zone", "vector", 5)
