"""Network, projection and snapping on the lattice."""

from __future__ import annotations

from pyspark.sql import functions as F

from citadine.functions import spatial, statistics
from citadine.operators import network
from citadine.plans.registry import query
from citadine.plans.surrogate import edges, incidents, nodes, pois, sql, table

TAGS = ("motorway", "primary", "residential", "alley", "service")
CLASSES = {"motorway": "highway", "primary": "avenue", "residential": "street", "service": "lane"}
RANKS = {"highway": 0, "avenue": 1, "street": 2, "lane": 3}


@query("undirected_simple", sql("SELECT u, v, min(length) AS length FROM (SELECT u, v, length FROM edges UNION ALL SELECT u, v, length + u % 7 - 3 FROM edges) GROUP BY ALL"))
def undirected_simple(spark, d):
    e = edges(spark, d)
    back = e.select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("length") + F.col("u") % 7 - 3).alias("length"))
    loops = e.select("u", F.col("u").alias("v"), "length")
    return network.undirected(e.unionByName(back).unionByName(loops))


@query("csr_arcs", sql("SELECT src, count(*) AS degree, CAST(sum(length) AS DOUBLE) AS total FROM arcs GROUP BY ALL"))
def csr_arcs(spark, d):
    return network.both_ways(edges(spark, d)).groupBy("src").agg(F.count("*").alias("degree"), F.sum("length").alias("total"))


_tag = "(['motorway', 'primary', 'residential', 'alley', 'service'])"
_rank = "CASE t WHEN 'motorway' THEN 0 WHEN 'primary' THEN 1 WHEN 'residential' THEN 2 WHEN 'service' THEN 3 END"


@query(
    "highway_fold",
    f"""WITH e AS (SELECT p_partkey, unnest([{_tag}[1 + p_partkey % 5], {_tag}[1 + (p_partkey // 5) % 5]]) AS t FROM part), r AS (SELECT p_partkey, min({_rank}) AS k FROM e GROUP BY ALL)
    SELECT coalesce((['highway', 'avenue', 'street', 'lane'])[k + 1], 'street') AS road_class, count(*) AS n FROM r GROUP BY ALL""",
)
def highway_fold(spark, d):
    tag = F.array(*[F.lit(t) for t in TAGS])
    k = F.col("p_partkey")
    tags = F.array(F.element_at(tag, (1 + k % 5).cast("int")), F.element_at(tag, (1 + F.floor(k / 5) % 5).cast("int")))
    folded = network.folded_class(tags, RANKS, CLASSES, "street")
    return table(spark, d, "part").groupBy(folded.alias("road_class")).agg(F.count("*").alias("n"))


@query("haversine", sql("SELECT a.node_id, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 4) AS metres FROM (SELECT node_id, pow(sin((radians(41.9) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(41.9)) * pow(sin((radians(-87.6) - radians(lon)) / 2), 2) AS h FROM nodes) a"))
def haversine(spark, d):
    metres = spatial.haversine(F.col("lat"), F.col("lon"), F.lit(41.9), F.lit(-87.6))
    return nodes(spark, d).select("node_id", F.round(metres, 4).alias("metres"))


@query("utm_zone", sql("SELECT node_id, CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS epsg FROM nodes"))
def utm_zone(spark, d):
    return nodes(spark, d).select("node_id", spatial.utm_zone(F.col("lat"), F.col("lon")).alias("epsg"))


def _utm_sql() -> str:
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    alphas = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    x = "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alphas, 1))
    y = "xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alphas, 1))
    return f"""WITH a AS (SELECT node_id, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon + 87.0) AS lam FROM nodes),
      b AS (SELECT node_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
      SELECT node_id, round(500000.0 + {radius!r}::DOUBLE * ({x}), 3) AS easting, round({radius!r}::DOUBLE * ({y}), 3) AS northing FROM b"""


@query("utm_project", sql(_utm_sql()))
def utm_project(spark, d):
    x, y = spatial.utm_xy(F.col("lat"), F.col("lon"), -87.0)
    return nodes(spark, d).select("node_id", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


def points(spark, d):
    p = incidents(spark, d).join(nodes(spark, d).select("node_id", "lat", "lon", "x", "y"), "node_id")
    dx, dy = (F.col("uid") % 61 - 30).cast("double"), (F.col("uid") % 43 - 21).cast("double")
    return p.select("uid", (F.col("lat") + dy / 111320.0).alias("lat"), (F.col("lon") + dx / (111320.0 * F.cos(F.radians(F.lit(41.88))))).alias("lon"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))


SNAP_SQL = """WITH p AS (SELECT i.uid, n.node_id AS near, n.x + (uid % 61 - 30) AS x, n.y + (uid % 43 - 21) AS y, n.lat + (uid % 43 - 21)::DOUBLE / 111320.0 AS lat, n.lon + (uid % 61 - 30)::DOUBLE / (111320.0 * cos(radians(41.88))) AS lon FROM incidents i JOIN nodes n USING (node_id)),
  s AS (SELECT e.u, e.v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v),
  t AS (SELECT p.*, s.*, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0.0), 1.0) AS k FROM p JOIN s ON s.u IN (near, near - 1, near - 50, near - 49, near - 51, near + 1, near + 50, near + 49, near + 51, near - 2, near - 100)),
  q AS (SELECT uid, u, v, round(sqrt(pow(x - ax - k * (bx - ax), 2) + pow(y - ay - k * (by_ - ay), 2)), 6) AS dist, pow(sin((radians(alat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(alat)) * pow(sin((radians(alon) - radians(lon)) / 2), 2) AS ha,
    pow(sin((radians(blat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(blat)) * pow(sin((radians(blon) - radians(lon)) / 2), 2) AS hb FROM t),
  r AS (SELECT uid, u, v, dist, CASE WHEN ha <= hb THEN u ELSE v END AS node_id FROM q QUALIFY row_number() OVER (PARTITION BY uid ORDER BY dist, u, v) = 1)"""


@query("snap_edges", sql(SNAP_SQL + " SELECT uid, u, v, node_id, round(dist, 4) AS dist_edge FROM r"))
def snap_edges(spark, d):
    out = network.snapped(points(spark, d), nodes(spark, d), edges(spark, d), "uid", 120.0)
    return out.select("uid", "u", "v", "node_id", F.round("dist_edge", 4).alias("dist_edge"))


@query("snap_stats", sql(SNAP_SQL + " SELECT count(node_id) AS snapped, count(*) AS total, round(quantile_cont(dist, 0.5), 4) AS median_m, round(quantile_cont(dist, 0.95), 4) AS p95_m, round(max(dist), 4) AS max_m, count(DISTINCT node_id) AS nodes FROM r"))
def snap_stats(spark, d):
    s = network.snap_summary(network.snapped(points(spark, d), nodes(spark, d), edges(spark, d), "uid", 120.0))
    return s.select("snapped", "total", *[F.round(c, 4).alias(c) for c in ("median_m", "p95_m", "max_m")], "nodes")


@query("induced_edges", sql("SELECT zone, u, v FROM zone_edges"))
def induced_edges(spark, d):
    return network.induced_edges(edges(spark, d), nodes(spark, d).select("zone", "node_id"), ["zone"]).select("zone", "u", "v")


@query("bbox_clip", sql("SELECT poi_id FROM pois, (SELECT min(x) - 100 AS x0, max(x) + 100 AS x1, min(y) - 100 AS y0, max(y) + 100 AS y1 FROM nodes) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"))
def bbox_clip(spark, d):
    box = nodes(spark, d).agg((F.min("x") - 100).alias("x0"), (F.max("x") + 100).alias("x1"), (F.min("y") - 100).alias("y0"), (F.max("y") + 100).alias("y1"))
    return pois(spark, d).crossJoin(F.broadcast(box)).where("x between x0 and x1 and y between y0 and y1").select("poi_id")


@query("quantize_u16", sql("SELECT node_id, CAST(round_even((x - x0) / (x1 - x0) * 65535, 0) AS BIGINT) AS qx, CAST(round_even((y - y0) / (y1 - y0) * 65535, 0) AS BIGINT) AS qy FROM nodes, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nodes)"))
def quantize_u16(spark, d):
    n = nodes(spark, d)
    box = n.agg(*[g(c).alias(f"{c}{k}") for c in "xy" for k, g in enumerate((F.min, F.max))])
    out = n.crossJoin(F.broadcast(box))
    return out.select("node_id", *[statistics.quantized(F.col(c), F.col(f"{c}0"), F.col(f"{c}1")).alias(f"q{c}") for c in "xy"])


@query("lasso_select", sql("SELECT node_id FROM nodes WHERE (((0.0 > y) <> (1500.0 > y) AND x < (2600.0 - 250.0) * (y - 0.0) / 1500.0 + 250.0) <> ((1500.0 > y) <> (400.0 > y) AND x < (4100.0 - 2600.0) * (y - 1500.0) / (400.0 - 1500.0) + 2600.0)) <> ((400.0 > y) <> (0.0 > y) AND x < (250.0 - 4100.0) * (y - 400.0) / (0.0 - 400.0) + 4100.0)"))
def lasso_select(spark, d):
    corners = [(250.0, 0.0), (2600.0, 1500.0), (4100.0, 400.0)]
    return nodes(spark, d).where(spatial.inside_polygon(F.col("x"), F.col("y"), corners)).select("node_id")
