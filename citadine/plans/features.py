"""Descriptors, places, similarity and embeddings of zones."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine.functions.statistics import location_quotient
from citadine.operators import chain, describing, embedding, network
from citadine.plans.registry import query
from citadine.plans.surrogate import counts, nodes, pois, sql, table, zone_edges, zone_pois

DIMS = ["log_nodes", "log_edges", "density", "mean_degree", "degree_1", "degree_2", "degree_3", "degree_4", "gyration", "elongation", "edge_mean", "edge_cv"]
STRUCT = """deg AS (SELECT n.zone, n.node_id, n.x, n.y, count(e.node_id) AS deg FROM nodes n LEFT JOIN (SELECT zone, u AS node_id FROM zone_edges UNION ALL SELECT zone, v FROM zone_edges) e ON e.node_id = n.node_id GROUP BY ALL),
  ctr AS (SELECT zone, avg(x) AS mx, avg(y) AS my FROM nodes GROUP BY zone),
  st AS (SELECT zone, count(*) AS n, sum(deg) / 2 AS m, avg((deg = 1)::INT) AS d1, avg((deg = 2)::INT) AS d2, avg((deg = 3)::INT) AS d3, avg((deg >= 4)::INT) AS d4, sqrt(avg(pow(x - mx, 2) + pow(y - my, 2))) AS gyration, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy FROM deg JOIN ctr USING (zone) GROUP BY zone),
  el AS (SELECT zone, (vx + vy) / 2 AS mid, sqrt(pow((vx - vy) / 2, 2) + cxy * cxy) AS gap FROM st),
  le AS (SELECT zone, avg(l) AS edge_mean, coalesce(stddev_pop(l) / avg(l), 0) AS edge_cv FROM (SELECT e.zone, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS l FROM zone_edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v) GROUP BY zone),
  sd AS (SELECT zone, ln(1 + n) AS log_nodes, ln(1 + m) AS log_edges, CASE WHEN n > 1 THEN 2 * m / (n * (n - 1)) ELSE 0 END AS density, 2 * m / n AS mean_degree, d1 AS degree_1, d2 AS degree_2, d3 AS degree_3, d4 AS degree_4, gyration, CASE WHEN mid + gap > 1e-12 THEN sqrt(greatest(mid - gap, 0) / (mid + gap)) ELSE 0 END AS elongation, coalesce(edge_mean, 0) AS edge_mean, coalesce(edge_cv, 0) AS edge_cv FROM st JOIN el USING (zone) LEFT JOIN le USING (zone))"""


def descriptors(spark, d):
    return describing.structural(nodes(spark, d).select("zone", "node_id", "x", "y"), zone_edges(spark, d).select("zone", "u", "v"), "zone")


@query("structural_descriptor", sql(f"WITH {STRUCT} SELECT zone, " + ", ".join(f"round({c}, 6) AS {c}" for c in DIMS) + " FROM sd"))
def structural_descriptor(spark, d):
    return descriptors(spark, d).select("zone", *[F.round(c, 6).alias(c) for c in DIMS])


@query("minmax_normalize", sql(f"WITH {STRUCT}, sr AS (SELECT zone, " + ", ".join(f"round({c}, 9) AS {c}" for c in DIMS) + " FROM sd) SELECT zone, " + ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) ELSE 0 END AS {c}" for c in DIMS) + " FROM sr"))
def minmax_normalize(spark, d):
    rounded = descriptors(spark, d).select("zone", *[F.round(c, 9).alias(c) for c in DIMS])
    return describing.minmax(rounded, DIMS).select("zone", *[F.round(c, 6).alias(c) for c in DIMS])


ROADS = ["highway", "avenue", "street", "lane"]


@query("hierarchy_fingerprint", sql("WITH c AS (SELECT zone, CASE u % 5 WHEN 0 THEN 'highway' WHEN 1 THEN 'avenue' WHEN 2 THEN 'street' WHEN 3 THEN 'lane' END AS road FROM zone_edges), s AS (SELECT zone, " + ", ".join(f"avg((road = '{r}')::INT) AS {r}" for r in ROADS) + " FROM c WHERE road IS NOT NULL GROUP BY zone) SELECT zone, " + ", ".join(f"round({r}, 6) AS {r}" for r in ROADS) + ", round(greatest(highway, avenue, street, lane), 6) AS dominance FROM s"))
def hierarchy_fingerprint(spark, d):
    names = F.array(*[F.lit(r) for r in [*ROADS, "other"]])
    e = zone_edges(spark, d).withColumn("road_class", F.element_at(names, (F.col("u") % 5 + 1).cast("int")))
    return describing.hierarchy(e, "zone", ROADS).select("zone", *[F.round(c, 6).alias(c) for c in [*ROADS, "dominance"]])


@query("poi_classify", "WITH t AS (SELECT p_partkey, CASE WHEN p_type LIKE 'ECONOMY%' OR p_size % 3 = 0 THEN 'amenity' ELSE 'shop' END AS key, p_brand AS value FROM part) SELECT CASE WHEN value IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'food' WHEN value IN ('Brand#21', 'Brand#22') THEN 'excluded' WHEN key = 'shop' THEN 'retail' ELSE 'unknown' END AS category, count(*) AS n FROM t GROUP BY ALL")
def poi_classify(spark, d):
    from citadine.sources.pois import Taxonomy

    brands = {(k, f"Brand#1{i}"): "food" for k in ("amenity", "shop") for i in (1, 2, 3)}
    taxonomy = Taxonomy(["food", "retail"], brands, {(k, f"Brand#2{i}") for k in ("amenity", "shop") for i in (1, 2)}, "retail")
    key = F.when(F.col("p_type").startswith("ECONOMY") | (F.col("p_size") % 3 == 0), "amenity").otherwise("shop")
    rows = table(spark, d, "part").select(F.when(key == "amenity", F.col("p_brand")).alias("amenity"), F.when(key == "shop", F.col("p_brand")).alias("shop"))
    return taxonomy.classified(rows, ["amenity", "shop"]).groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("poi_in_zone", sql("SELECT zone, poi_id FROM zone_pois"))
def poi_in_zone(spark, d):
    return zone_pois(spark, d).select("zone", "poi_id")


def profile(spark, d):
    return zone_pois(spark, d).groupBy("zone", "category").agg(F.count("*").alias("c"))


@query("poi_profile", sql("SELECT zone, category, count(*) AS c, round(count(*) / any_value(n), 6) AS per_node FROM zone_pois JOIN (SELECT zone, count(*) AS n FROM nodes GROUP BY zone) USING (zone) GROUP BY zone, category"))
def poi_profile(spark, d):
    size = nodes(spark, d).groupBy("zone").agg(F.count("*").alias("n"))
    return profile(spark, d).join(size, "zone").select("zone", "category", "c", F.round(F.col("c") / F.col("n"), 6).alias("per_node"))


@query("poi_entropy", sql("WITH p AS (SELECT zone, category, count(*) AS c FROM zone_pois GROUP BY ALL), q AS (SELECT zone, c / sum(c) OVER (PARTITION BY zone) AS p FROM p) SELECT zone, round(sum(-p * ln(p)), 6) AS entropy, round(sum(-p * ln(p)) / ln(6), 6) AS entropy_norm FROM q GROUP BY zone"))
def poi_entropy(spark, d):
    return describing.entropy(profile(spark, d), "zone", 6).select("zone", F.round("entropy", 6).alias("entropy"), F.round("entropy_norm", 6).alias("entropy_norm"))


LQ = "lq AS (SELECT zone, category, (count(*) / any_value(city)) / (any_value(n)::DOUBLE / (SELECT count(*) FROM nodes)) AS lq FROM zone_pois JOIN (SELECT category, count(*) AS city FROM pois GROUP BY category) USING (category) JOIN (SELECT zone, count(*) AS n FROM nodes GROUP BY zone) USING (zone) GROUP BY zone, category)"


def quotients(spark, d):
    city = pois(spark, d).groupBy("category").agg(F.count("*").alias("city"))
    size = nodes(spark, d).groupBy("zone").agg(F.count("*").alias("n"))
    total = nodes(spark, d).agg(F.count("*").alias("total"))
    rows = profile(spark, d).join(city, "category").join(size, "zone").crossJoin(F.broadcast(total))
    return rows.select("zone", "category", location_quotient(F.col("c"), F.col("city"), F.col("n"), F.col("total")).alias("lq"))


@query("location_quotient", sql(f"WITH {LQ} SELECT zone, category, round(lq, 6) AS lq FROM lq"))
def location_quotients(spark, d):
    return quotients(spark, d).withColumn("lq", F.round("lq", 6))


@query("relative_specialisation", sql(f"WITH {LQ} SELECT zone, category, round(lq / nullif(median(lq) OVER (PARTITION BY zone), 0), 5) AS relative FROM lq"))
def relative_specialisation(spark, d):
    q = quotients(spark, d)
    mid = q.groupBy("zone").agg(F.percentile("lq", F.lit(0.5)).alias("mid"))
    return q.join(mid, "zone").select("zone", "category", F.round(F.when(F.col("mid") != 0, F.col("lq") / F.col("mid")), 5).alias("relative"))


@query("poi_nearest_snapshot", sql("WITH y AS (SELECT DISTINCT year FROM pois WHERE year % 3 <> 0), m AS (SELECT DISTINCT mes, CAST(substr(mes, 1, 4) AS INTEGER) + 22 AS own FROM counts) SELECT mes, arg_min(year, abs(year - own) * 10000 + year) AS year FROM m, y GROUP BY mes"))
def poi_nearest_snapshot(spark, d):
    years = pois(spark, d).where("year % 3 <> 0").select("year").distinct()  # one row per snapshot
    months = counts(spark, d).select("mes").distinct().withColumn("own", F.substring("mes", 1, 4).cast("int") + 22)
    return months.crossJoin(F.broadcast(years)).groupBy("mes").agg(F.min_by("year", F.struct(F.abs(F.col("year") - F.col("own")), "year")).alias("year"))


@query("poi_counts_by_year", sql("SELECT year, category, count(*) AS n, dense_rank() OVER (ORDER BY year) - 1 AS code FROM pois GROUP BY year, category"))
def poi_counts_by_year(spark, d):
    grouped = pois(spark, d).groupBy("year", "category").agg(F.count("*").alias("n"))
    return grouped.withColumn("code", F.dense_rank().over(Window.orderBy("year")) - 1)  # one row per year and category


@query("poi_unknown_report", "WITH t AS (SELECT p_brand AS tag, p_size % 4 = 0 AS unknown FROM part) SELECT tag, count(*) AS n, round((SELECT avg(unknown::INT) FROM t), 6) AS unknown_rate FROM t WHERE unknown GROUP BY tag QUALIFY row_number() OVER (ORDER BY count(*) DESC, tag) <= 25")
def poi_unknown_report(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("tag"), (F.col("p_size") % 4 == 0).alias("unknown"))
    rate = t.agg(F.round(F.avg(F.col("unknown").cast("int")), 6).alias("unknown_rate"))
    return t.where("unknown").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(25).crossJoin(F.broadcast(rate))


@query("dictionary_codes", "SELECT p_type, p_brand, dense_rank() OVER (ORDER BY p_type) - 1 AS type_code, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_code FROM (SELECT DISTINCT p_type, p_brand FROM part)")
def dictionary_codes(spark, d):
    pairs = table(spark, d, "part").select("p_type", "p_brand").distinct()  # a dictionary: one row per pair of values
    return pairs.withColumns({"type_code": F.dense_rank().over(Window.orderBy("p_type")) - 1, "brand_code": F.dense_rank().over(Window.orderBy("p_brand")) - 1})


def long_embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


Z = "z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT vec_id, dim, CASE WHEN stddev_pop(v) OVER w > 1e-12 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END AS v FROM z WINDOW w AS (PARTITION BY dim))"


@query("zscore_block", f"WITH {Z} SELECT vec_id, dim, round(v, 6) AS v FROM s")
def zscore_block(spark, d):
    return describing.zscores(long_embeddings(spark, d), "dim", "v").select("vec_id", "dim", F.round("v", 6).alias("v"))


@query("fuse_blocks", f"WITH {Z} SELECT vec_id, dim, round(CASE WHEN dim < 16 THEN v * 2 / sqrt(16) ELSE v * 0.5 / sqrt(48) END, 6) AS v FROM s")
def fuse_blocks(spark, d):
    """Two blocks of the vectors, standardised, weighted and joined again."""
    whole = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 16).alias("near"), F.slice("embedding", 17, 48).alias("far"))
    blocks = whole.select("id", *[F.transform(c, lambda v: v.cast("double")).alias(c) for c in ("near", "far")])
    vectors = chain.fused(blocks, {"near": 2.0, "far": 0.5})
    return vectors.select(F.col("id").alias("vec_id"), F.posexplode("vector").alias("dim", "v")).select("vec_id", "dim", F.round("v", 6).alias("v"))


def nearest(spark, d, distinct_label: bool):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return embedding.nearest(e, "vec_id", "embedding", 5, "label" if distinct_label else None)


COS = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {cond} QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) <= 5"


@query("cosine_topk", COS.format(cond=""))
def cosine_topk(spark, d):
    return nearest(spark, d, False)


@query("cosine_topk_distinct_label", COS.format(cond="AND a.label <> b.label"))
def cosine_topk_distinct_label(spark, d):
    return nearest(spark, d, True)


@query("jaccard_pairs", "WITH b AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem), n AS (SELECT k, count(*) AS n FROM b GROUP BY k) SELECT x.k AS a, y.k AS b, count(*) AS common, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS jaccard FROM b x JOIN b y ON x.i = y.i AND x.k < y.k JOIN n p ON p.k = x.k JOIN n q ON q.k = y.k GROUP BY x.k, y.k HAVING count(*) >= 2")
def jaccard_pairs(spark, d):
    baskets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("i"))
    return describing.jaccard_pairs(baskets, "k", "i", 2).withColumn("jaccard", F.round("jaccard", 6))


def _refined(k: int) -> str:
    return f"l{k} AS (SELECT l.zone, l.node_id, substr(sha256(l.label || '|' || coalesce(string_agg(o.label, ',' ORDER BY o.label), '')), 1, 16) AS label FROM l{k - 1} l LEFT JOIN za a ON a.src = l.node_id LEFT JOIN l{k - 1} o ON o.node_id = a.dst GROUP BY l.zone, l.node_id, l.label)"


@query("wl_labels", sql(f"""WITH za AS (SELECT zone, u AS src, v AS dst FROM zone_edges UNION ALL SELECT zone, v, u FROM zone_edges), l0 AS (SELECT n.zone, n.node_id, 'd' || count(a.dst) AS label FROM nodes n LEFT JOIN za a ON a.src = n.node_id GROUP BY n.zone, n.node_id),
  {_refined(1)}, {_refined(2)} SELECT zone, node_id, 0 AS round, label FROM l0 UNION ALL SELECT zone, node_id, 1, label FROM l1 UNION ALL SELECT zone, node_id, 2, label FROM l2"""))
def wl_labels(spark, d):
    return zone_labels(spark, d, 2).select("zone", "node_id", "round", "label")


def zone_arcs(spark, d):
    e = zone_edges(spark, d)
    return e.select("zone", F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(e.select("zone", F.col("v").alias("src"), F.col("u").alias("dst")))


def zone_labels(spark, d, rounds):
    return describing.wl_labels(nodes(spark, d).select("zone", "node_id"), zone_arcs(spark, d), "zone", rounds)


def zone_places(spark, d):
    return nodes(spark, d).select("zone", "node_id", "x", "y")


def classed_arcs(spark, d):
    names = F.array(*[F.lit(r) for r in ROADS])
    return zone_arcs(spark, d).withColumn("road_class", F.element_at(names, ((F.col("src") + F.col("dst")) % 4 + 1).cast("int")))


@query("graph2vec")
def graph2vec(spark, d):
    return embedding.embedded("graph2vec", zone_places(spark, d), classed_arcs(spark, d), "zone")


@query("netlsd")
def netlsd(spark, d):
    return embedding.heat_signatures(nodes(spark, d).select("zone", "node_id"), zone_arcs(spark, d), "zone")


@query("scattering")
def scattering(spark, d):
    return embedding.embedded("scattering", zone_places(spark, d), classed_arcs(spark, d), "zone")


@query("wwl")
def wwl(spark, d):
    return embedding.embedded("wwl", zone_places(spark, d), classed_arcs(spark, d), "zone", classes=ROADS)


@query("wwl_distances")
def wwl_distances(spark, d):
    """Rows with ``member``: of zone a its class b, the smallest zone of the same shape. The others: the distance of classes a <= b, which is that of all their members; a = b is that of two members."""
    members, pairs = embedding.transport_classes(embedding.node_clouds(zone_places(spark, d), classed_arcs(spark, d), "zone", ROADS), "zone")
    own = members.select(F.col("zone").alias("a"), F.col("class").alias("b"), F.lit(None).cast("double").alias("distance"), F.lit(True).alias("member"))
    return own.unionByName(pairs.withColumn("member", F.lit(False)))


@query("pca_2d")
def pca_2d(spark, d):
    return embedding.pca(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 2)


@query("hdbscan")
def hdbscan(spark, d):
    return embedding.clustered(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 5)
