"""Trajectories, group contrasts, matching and synthetic truth."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine import storage
from citadine.functions import statistics
from citadine.operators import network, tracking
from citadine.plans.features import DIMS, STRUCT, descriptors, profile
from citadine.plans.regions import extract_hotspots
from citadine.plans.registry import query
from citadine.plans.surrogate import counts, edges, incidents, nodes, sql, table

HOT = "hot AS (SELECT mes, zone, node_id, dense_rank() OVER (ORDER BY mes) - 1 AS t FROM counts JOIN nodes USING (node_id) WHERE c >= 1)"


def hot_sets(spark, d):
    months = counts(spark, d).select("mes").distinct().withColumn("t", F.row_number().over(Window.orderBy("mes")) - 1)  # one row per month
    return counts(spark, d).join(F.broadcast(months), "mes").join(nodes(spark, d).select("node_id", "zone"), "node_id").select("mes", "t", "zone", "node_id")


@query("trajectory_candidates", sql(f"WITH {HOT}, n AS (SELECT t, zone, count(*) AS n FROM hot GROUP BY ALL), p AS (SELECT a.t, b.t AS t0, a.zone AS a, b.zone AS b, count(*) AS common FROM hot a JOIN hot b ON a.node_id = b.node_id AND a.t > b.t AND a.t - b.t <= 3 GROUP BY ALL) SELECT p.t, p.t0, p.a, p.b, round(common / (x.n + y.n - common), 6) AS iou FROM p JOIN n x ON x.t = p.t AND x.zone = p.a JOIN n y ON y.t = p.t0 AND y.zone = p.b WHERE common / (x.n + y.n - common) >= 0.2"))
def trajectory_candidates(spark, d):
    return tracking.overlaps(hot_sets(spark, d), "t", "zone", "node_id", 3, 0.2).withColumn("iou", F.round("iou", 6))


MEM = "mem AS (SELECT zone, mes, sum(c) AS crimes FROM counts JOIN nodes USING (node_id) GROUP BY ALL HAVING sum(c) >= 4), seq AS (SELECT *, abs(crimes - lag(crimes) OVER w) / (crimes + lag(crimes) OVER w) AS iou FROM mem WINDOW w AS (PARTITION BY zone ORDER BY mes)), tm AS (SELECT zone, count(DISTINCT mes) / (SELECT count(DISTINCT mes) FROM counts) AS frequency, avg(crimes) AS intensity, max(crimes) AS peak, avg(iou) AS stability, count(*) AS appearances FROM seq GROUP BY zone)"


def track_metrics(spark, d):
    members = counts(spark, d).join(nodes(spark, d).select("node_id", "zone"), "node_id").groupBy("zone", "mes").agg(F.sum("c").alias("crimes")).where("crimes >= 4")
    before = F.lag("crimes").over(Window.partitionBy("zone").orderBy("mes"))
    members = members.withColumn("iou", F.abs(F.col("crimes") - before) / (F.col("crimes") + before))
    months = counts(spark, d).agg(F.count_distinct("mes").alias("months"))
    return tracking.trajectory_metrics(members.crossJoin(F.broadcast(months)), "zone", "mes", F.col("months"), "crimes", "iou")


@query("trajectory_metrics", sql(f"WITH {MEM} SELECT zone, round(frequency, 6) AS frequency, round(intensity, 6) AS intensity, CAST(peak AS BIGINT) AS peak, round(stability, 6) AS stability, appearances FROM tm"))
def trajectory_metrics(spark, d):
    return track_metrics(spark, d).select("zone", *[F.round(c, 6).alias(c) for c in ("frequency", "intensity")], "peak", F.round("stability", 6).alias("stability"), "appearances")


@query("quadrants", sql(f"WITH {MEM}, m AS (SELECT median(frequency) AS mf, median(stability) AS ms FROM tm WHERE stability IS NOT NULL) SELECT CASE WHEN stability IS NULL THEN 'single' ELSE CASE WHEN frequency >= mf THEN 'frequent' ELSE 'rare' END || '-' || CASE WHEN stability >= ms THEN 'stable' ELSE 'shifting' END END AS quadrant, count(*) AS n FROM tm, m GROUP BY ALL"))
def quadrants(spark, d):
    return tracking.quadrants(track_metrics(spark, d))


@query("frequency_inheritance", sql(f"WITH {MEM} SELECT n.node_id, round(coalesce(tm.frequency, 0), 6) AS frequency FROM nodes n LEFT JOIN tm USING (zone)"))
def frequency_inheritance(spark, d):
    return nodes(spark, d).select("node_id", "zone").join(track_metrics(spark, d).select("zone", "frequency"), "zone", "left").select("node_id", F.round(F.coalesce("frequency", F.lit(0.0)), 6).alias("frequency"))


def two_groups(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')")
    return o.select(F.col("o_orderpriority").alias("tipo"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("grp"), F.round("o_totalprice", -3).alias("v"))


GRP = "g AS (SELECT o_orderpriority AS tipo, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS grp, round(o_totalprice / 1000) * 1000 AS v FROM orders WHERE o_orderstatus IN ('F', 'O')), cells AS (SELECT tipo, v, count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb FROM g GROUP BY ALL), r AS (SELECT *, coalesce(sum(nb) OVER (PARTITION BY tipo ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0 FROM cells), us AS (SELECT tipo, sum(na) AS n_a, sum(nb) AS n_b, sum(na * (b0 + nb / 2)) AS u, sum(pow(na + nb, 3) - na - nb) AS ties FROM r GROUP BY tipo)"


@query("mannwhitney_u", f"WITH {GRP} SELECT tipo, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, CAST(u AS DOUBLE) AS u FROM us")
def mannwhitney_u(spark, d):
    return tracking.rank_sums(two_groups(spark, d), ["tipo"], "grp", "v").select("tipo", "n_a", "n_b", "u")


@query("cliffs_delta", f"WITH {GRP} SELECT tipo, round(2 * u / (n_a * n_b) - 1, 6) AS delta FROM us")
def cliffs_delta(spark, d):
    return tracking.rank_sums(two_groups(spark, d), ["tipo"], "grp", "v").select("tipo", F.round("delta", 6).alias("delta"))


@query("group_means", "SELECT o_orderpriority AS tipo, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 4) AS mean_a, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 4) AS mean_b FROM orders GROUP BY ALL")
def group_means(spark, d):
    mean = lambda s: F.round(F.coalesce(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), F.lit(0.0)), 4)
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tipo")).agg(mean("F").alias("mean_a"), mean("O").alias("mean_b"))


@query("mannwhitney_p")
def mannwhitney_p(spark, d):
    r = tracking.rank_sums(two_groups(spark, d), ["tipo"], "grp", "v")
    return r.select("tipo", "u", F.round(tracking.u_p("u", "n_a", "n_b", "ties"), 6).alias("p"))


@query("bh_adjust", "WITH p AS (SELECT p_brand AS brand, p_partkey AS k, (p_partkey * 7919 % 1000) / 1000.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY p, k) AS r, count(*) OVER (PARTITION BY brand) AS n FROM p) SELECT brand, k, round(least(1, min(p * n / r) OVER (PARTITION BY brand ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM r")
def bh_adjust(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"), (F.col("p_partkey") * 7919 % 1000 / 1000.0).alias("p"))
    return tracking.adjusted(p, ["brand"], "p", "k").select("brand", "k", F.round("p_adj", 6).alias("p_adj"))


@query("tercile_split", "WITH q AS (SELECT quantile_cont(o_totalprice, 1.0 / 3) AS lo, quantile_cont(o_totalprice, 2.0 / 3) AS hi FROM orders) SELECT count(*) FILTER (o_totalprice >= hi) AS persistent, count(*) FILTER (o_totalprice <= lo) AS episodic FROM orders, q")
def tercile_split(spark, d):
    return tracking.terciles(table(spark, d, "orders"), "o_totalprice")


ZC = "zc AS (SELECT zone, sum(c) AS crimes FROM counts JOIN nodes USING (node_id) GROUP BY zone)"


def matched(spark, d):
    s = descriptors(spark, d).select("zone", "log_nodes", "gyration", "mean_degree")
    c = counts(spark, d).join(nodes(spark, d).select("node_id", "zone"), "node_id").groupBy("zone").agg(F.sum("c").alias("crimes"))
    rows = s.join(c, "zone")
    a = rows.select(F.col("zone").alias("a"), *[F.col(x).alias(f"a_{x}") for x in ("log_nodes", "gyration", "mean_degree", "crimes")])
    b = rows.select(F.col("zone").alias("b"), *[F.col(x).alias(f"b_{x}") for x in ("log_nodes", "gyration", "mean_degree", "crimes")])
    distance = F.sqrt(F.pow(F.col("a_log_nodes") - F.col("b_log_nodes"), 2) + F.pow((F.col("a_gyration") - F.col("b_gyration")) / 100, 2) + F.pow(F.col("a_mean_degree") - F.col("b_mean_degree"), 2))
    hi, lo = F.greatest("a_crimes", "b_crimes"), F.least("a_crimes", "b_crimes")
    pairs = a.join(b, F.col("a") < F.col("b")).select("a", "b", distance.alias("distance"), (hi / lo).alias("ratio"))  # pairs of zones
    return pairs.where("distance <= 0.2 and ratio >= 1.1")


@query("matched_candidates", sql(f"WITH {STRUCT}, {ZC}, r AS (SELECT * FROM sd JOIN zc USING (zone)) SELECT a.zone AS a, b.zone AS b, round(sqrt(pow(a.log_nodes - b.log_nodes, 2) + pow((a.gyration - b.gyration) / 100, 2) + pow(a.mean_degree - b.mean_degree, 2)), 6) AS distance, round(greatest(a.crimes, b.crimes) / least(a.crimes, b.crimes), 6) AS ratio FROM r a JOIN r b ON a.zone < b.zone WHERE sqrt(pow(a.log_nodes - b.log_nodes, 2) + pow((a.gyration - b.gyration) / 100, 2) + pow(a.mean_degree - b.mean_degree, 2)) <= 0.2 AND greatest(a.crimes, b.crimes) / least(a.crimes, b.crimes) >= 1.1"))
def matched_candidates(spark, d):
    return matched(spark, d).select("a", "b", F.round("distance", 6).alias("distance"), F.round("ratio", 6).alias("ratio"))


@query("matched_pairs")
def matched_pairs(spark, d):
    return tracking.capped_pairs(matched(spark, d))


@query("pair_contrast", sql("WITH p AS (SELECT zone, category, count(*) AS c FROM zone_pois WHERE zone IN (0, 11) GROUP BY ALL), a AS (SELECT category, c FROM p WHERE zone = 0), b AS (SELECT category, c FROM p WHERE zone = 11) SELECT coalesce(a.category, b.category) AS category, coalesce(a.c, 0) AS a, coalesce(b.c, 0) AS b, coalesce(a.c, 0) - coalesce(b.c, 0) AS delta, CASE WHEN b.c IS NULL THEN 'only a' WHEN a.c IS NULL THEN 'only b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.category = b.category"))
def pair_contrast(spark, d):
    p = profile(spark, d)
    a, b = p.where("zone = 0").select("category", F.col("c").alias("a")), p.where("zone = 11").select("category", F.col("c").alias("b"))
    side = F.when(F.col("b").isNull(), "only a").when(F.col("a").isNull(), "only b").otherwise("both")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "category", "full").select("category", zero("a").alias("a"), zero("b").alias("b"), (zero("a") - zero("b")).alias("delta"), side.alias("side"))


DET = "det AS (SELECT mes, node_id FROM counts WHERE c >= 2), tru AS (SELECT DISTINCT mes, node_id FROM incidents WHERE tipo IN ('1-URGENT', '2-HIGH')), sc AS (SELECT m.mes, (SELECT count(*) FROM det WHERE det.mes = m.mes) AS n_d, (SELECT count(*) FROM tru WHERE tru.mes = m.mes) AS n_t, (SELECT count(*) FROM det JOIN tru USING (mes, node_id) WHERE det.mes = m.mes) AS hit FROM (SELECT DISTINCT mes FROM counts) m), sx AS (SELECT mes, CASE WHEN n_d > 0 THEN hit / n_d ELSE 0 END AS ppv, CASE WHEN n_t > 0 THEN hit / n_t ELSE 0 END AS sensitivity FROM sc), sf AS (SELECT *, CASE WHEN ppv + sensitivity > 0 THEN 2 * ppv * sensitivity / (ppv + sensitivity) ELSE 0 END AS f1 FROM sx)"


def scores(spark, d):
    detected = counts(spark, d).where("c >= 2").select("mes", "node_id")
    truth = incidents(spark, d).where("tipo in ('1-URGENT', '2-HIGH')").select("mes", "node_id").distinct()
    months = counts(spark, d).select("mes").distinct()
    n = lambda df, name: df.groupBy("mes").agg(F.count("*").alias(name))
    hit = detected.join(truth, ["mes", "node_id"], "left_semi")
    s = months.join(n(detected, "n_d"), "mes", "left").join(n(truth, "n_t"), "mes", "left").join(n(hit, "hit"), "mes", "left").fillna(0)
    s = s.select("mes", F.coalesce(statistics.ratio(F.col("hit"), F.col("n_d")), F.lit(0.0)).alias("ppv"), F.coalesce(statistics.ratio(F.col("hit"), F.col("n_t")), F.lit(0.0)).alias("sensitivity"))
    return s.withColumn("f1", F.coalesce(statistics.ratio(2 * F.col("ppv") * F.col("sensitivity"), F.col("ppv") + F.col("sensitivity")), F.lit(0.0)))


@query("score_ppv_sens", sql(f"WITH {DET} SELECT mes, round(ppv, 6) AS ppv, round(sensitivity, 6) AS sensitivity, round(f1, 6) AS f1 FROM sf"))
def score_ppv_sens(spark, d):
    return scores(spark, d).select("mes", *[F.round(c, 6).alias(c) for c in ("ppv", "sensitivity", "f1")])


@query("score_stats", sql(f"WITH {DET} SELECT round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS sd, round(stddev_samp(f1) / avg(f1), 6) AS cv FROM sf"))
def score_stats(spark, d):
    mean, sd = F.avg("f1"), F.stddev_samp("f1")
    return scores(spark, d).agg(F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"), F.round(sd / mean, 6).alias("cv"))


@query("set_intersection", sql("SELECT node_id FROM counts WHERE c >= 2 INTERSECT SELECT node_id FROM incidents WHERE tipo = '1-URGENT'"))
def set_intersection(spark, d):
    return counts(spark, d).where("c >= 2").select("node_id").intersect(incidents(spark, d).where("tipo = '1-URGENT'").select("node_id"))


@query("set_remainder", sql("SELECT node_id FROM nodes EXCEPT SELECT node_id FROM counts WHERE c >= 2"))
def set_remainder(spark, d):
    return nodes(spark, d).select("node_id").join(counts(spark, d).where("c >= 2"), "node_id", "left_anti")


@query("trajectory_footprint", sql("SELECT zone, count(DISTINCT node_id) AS union_size FROM counts JOIN nodes USING (node_id) GROUP BY zone"))
def trajectory_footprint(spark, d):
    return counts(spark, d).join(nodes(spark, d).select("node_id", "zone"), "node_id").groupBy("zone").agg(F.count_distinct("node_id").alias("union_size"))


@query("seed_movement", sql("WITH s AS (SELECT mes, zone, node_id FROM counts JOIN nodes USING (node_id) QUALIFY row_number() OVER (PARTITION BY mes, zone ORDER BY c DESC, node_id) = 1), p AS (SELECT zone, mes, lag(node_id) OVER (PARTITION BY zone ORDER BY mes) AS a, node_id AS b FROM s) SELECT zone, mes, a, b, coalesce(d, 360.0) AS metres FROM p LEFT JOIN kernel k ON k.src = p.a AND k.dst = p.b WHERE a IS NOT NULL"))
def seed_movement(spark, d):
    """Geodesic steps of a zone's seed from month to month, censored at the kernel's reach."""
    from citadine.plans.regions import distances

    seeds = network.first_by(counts(spark, d).join(nodes(spark, d).select("node_id", "zone"), "node_id"), ["mes", "zone"], [F.desc("c"), F.col("node_id")])
    steps = seeds.select("zone", "mes", F.lag("node_id").over(Window.partitionBy("zone").orderBy("mes")).alias("a"), F.col("node_id").alias("b")).where("a is not null")
    near = distances(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"), "d")
    return steps.join(near, ["a", "b"], "left").select("zone", "mes", "a", "b", F.coalesce("d", F.lit(360.0)).alias("metres"))


@query("link_trajectories")
def link_trajectories(spark, d):
    found = storage.saved(extract_hotspots(spark, d).select("mes", "id", "nodes"), "found")
    months = counts(spark, d).select("mes").distinct().withColumn("t", F.row_number().over(Window.orderBy("mes")) - 1)
    own = found.join(F.broadcast(months), "mes")
    pairs = tracking.overlaps(own.select("t", "id", F.explode("nodes").alias("node_id")), "t", "id", "node_id", 3, 0.2)
    return tracking.linked(own.select("id", "t", "mes"), pairs, 3)


@query("poisson_clusters")
def poisson_clusters(spark, d):
    """Planted clusters: 15 parent nodes by hash, 200 children each on an end of an edge near by, 100 incidents anywhere; by hash, so always the same."""
    n = nodes(spark, d).select("node_id")
    size = n.count()
    parents = n.orderBy(F.xxhash64(F.lit(11), "node_id"), "node_id").limit(15).withColumn("p", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(11), "node_id"), "node_id")))
    arcs = network.both_ways(edges(spark, d)).select(F.col("src").alias("node_id"), "dst")
    around = arcs.join(F.broadcast(parents), "node_id").groupBy("p", "node_id").agg(F.sort_array(F.collect_list("dst")).alias("ends"))
    children = around.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(200)))).withColumn("h", F.pmod(F.xxhash64(F.lit(13), "p", "k"), F.lit(2) * F.size("ends")).cast("int"))
    placed = children.select(F.when(F.col("h") < F.size("ends"), F.element_at("ends", (F.col("h") % F.size("ends") + 1).cast("int"))).otherwise(F.col("node_id")).alias("node_id"), F.lit(True).alias("planted"))
    noise = spark.range(100).select(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(size)).alias("node_id"), F.lit(False).alias("planted"))
    return placed.unionByName(noise).groupBy("node_id").agg(F.count("*").alias("c"), F.count_if("planted").alias("planted"))
