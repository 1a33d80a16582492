"""Counts, kernels, fields, regions, selection and evaluation on the lattice."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine import storage
from citadine.functions import statistics
from citadine.operators import field as fields
from citadine.operators import network, regions, selecting
from citadine.plans.registry import query
from citadine.plans.surrogate import CUTOFF, MIN_LENGTH, SIGMA, counts, edges, incidents, nodes, sql, table

LLR_SQL = "CASE WHEN n_in > 0 AND n_total * size_in / size_total > 0 AND n_in > n_total * size_in / size_total AND n_in < n_total THEN n_in * ln(n_in / (n_total * size_in / size_total)) + (n_total - n_in) * ln((n_total - n_in) / (n_total - n_total * size_in / size_total)) ELSE 0.0 END"


def distances(spark, d):
    return fields.stored_kernel(network.both_ways(edges(spark, d)), CUTOFF, MIN_LENGTH)


def reach(spark, d):
    """The kernel packed for tasks or, where it is too large for that, as rows."""
    near = regions.packed_kernel(network.both_ways(edges(spark, d)), CUTOFF, math.ceil(CUTOFF / MIN_LENGTH))
    return distances(spark, d) if near is None else near


def density(spark, d, sigma: float = SIGMA):
    return fields.density_field(counts(spark, d), distances(spark, d), sigma, ["mes"])


@query("node_month_counts", sql("SELECT mes, node_id, c FROM counts"))
def node_month_counts(spark, d):
    return fields.node_counts(incidents(spark, d), ["mes"])


@query("node_month_category_counts", sql("SELECT mes, tipo, node_id, count(*) AS c FROM incidents GROUP BY ALL"))
def node_month_category_counts(spark, d):
    return fields.node_counts(incidents(spark, d), ["mes", "tipo"])


@query("hottest_node", sql("SELECT mes, arg_max(node_id, c * 1000000 - node_id) AS node_id, max(c) AS c FROM counts GROUP BY mes"))
def hottest_node(spark, d):
    return counts(spark, d).groupBy("mes").agg(F.max_by("node_id", F.struct("c", -F.col("node_id"))).alias("node_id"), F.max("c").alias("c"))


@query("month_category_matrix", sql("SELECT mes, " + ", ".join(f"count(*) FILTER (tipo = '{t}') AS p{t[0]}" for t in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM incidents GROUP BY mes"))
def month_category_matrix(spark, d):
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    out = incidents(spark, d).groupBy("mes").pivot("tipo", kinds).count().fillna(0)
    return out.select("mes", *[F.col(f"`{k}`").alias(f"p{k[0]}") for k in kinds])


@query("geodesic_kernel", sql("SELECT src, dst, d FROM kernel"))
def geodesic_kernel(spark, d):
    return distances(spark, d)


@query("density_field", sql("SELECT mes, node_id, round(f, 6) AS f FROM field"))
def density_field(spark, d):
    return density(spark, d).select("mes", "node_id", F.round("f", 6).alias("f"))


@query("density_floor", sql("SELECT mes, node_id FROM field QUALIFY f >= 0.1 * max(f) OVER (PARTITION BY mes)"))
def density_floor(spark, d):
    return fields.above_floor(density(spark, d), 0.1, ["mes"]).select("mes", "node_id")


@query("local_maxima", sql("WITH h AS (SELECT mes, node_id, round(f, 9) AS h FROM field) SELECT mes, node_id FROM h WHERE NOT EXISTS (SELECT 1 FROM arcs a JOIN h o ON o.node_id = a.dst WHERE a.src = h.node_id AND o.mes = h.mes AND (o.h > h.h OR (o.h = h.h AND o.node_id < h.node_id)))"))
def local_maxima(spark, d):
    return fields.local_maxima(density(spark, d), network.both_ways(edges(spark, d)), ["mes"]).select("mes", "node_id")


@query("topk_nodes_month", sql("SELECT mes, node_id, round(f, 6) AS f, row_number() OVER (PARTITION BY mes ORDER BY round(f, 9) DESC, node_id) AS rank FROM field QUALIFY rank <= 20"))
def topk_nodes_month(spark, d):
    ranked = selecting.select_fixed(density(spark, d), ["mes"], 20, [F.round("f", 9).desc(), F.col("node_id")])
    return ranked.select("mes", "node_id", F.round("f", 6).alias("f"), "rank")


def zone_scores_of(spark, d):
    z = nodes(spark, d).select("node_id", "zone")
    size = z.groupBy("zone").agg(F.count("*").alias("n_nodes"))
    return counts(spark, d).join(z, "node_id").groupBy("mes", "zone").agg(F.sum("c").alias("score")).join(size, "zone").select("mes", "zone", "score", "n_nodes")


ZS = "zs AS (SELECT mes, zone, sum(c) AS score, any_value(n_nodes) AS n_nodes FROM counts JOIN nodes USING (node_id) JOIN (SELECT zone, count(*) AS n_nodes FROM nodes GROUP BY zone) USING (zone) GROUP BY mes, zone)"


@query("zone_scores", sql(f"WITH {ZS} SELECT mes, zone, CAST(score AS BIGINT) AS score, n_nodes, round(score / n_nodes, 6) AS density FROM zs"))
def zone_scores(spark, d):
    return zone_scores_of(spark, d).withColumn("density", F.round(F.col("score") / F.col("n_nodes"), 6))


@query("zone_by_category", sql("SELECT mes, zone, tipo, count(*) AS c FROM incidents JOIN nodes USING (node_id) GROUP BY ALL"))
def zone_by_category(spark, d):
    return incidents(spark, d).join(nodes(spark, d).select("node_id", "zone"), "node_id").groupBy("mes", "zone", "tipo").agg(F.count("*").alias("c"))


@query("zone_seed", sql("SELECT mes, zone, node_id AS seed_node, c FROM counts JOIN nodes USING (node_id) QUALIFY row_number() OVER (PARTITION BY mes, zone ORDER BY c DESC, node_id) = 1"))
def zone_seed(spark, d):
    joined = counts(spark, d).join(nodes(spark, d).select("node_id", "zone"), "node_id")
    return network.first_by(joined, ["mes", "zone"], [F.desc("c"), F.col("node_id")]).select("mes", "zone", F.col("node_id").alias("seed_node"), "c")


def scored(spark, d):
    z = zone_scores_of(spark, d)
    w = Window.partitionBy("mes")
    size = nodes(spark, d).agg(F.count("*").cast("double").alias("size_total"))
    z = z.withColumn("n_total", F.sum("score").over(w)).crossJoin(F.broadcast(size))
    return z.withColumn("llr", statistics.poisson_llr(F.col("score") * 1.0, F.col("n_nodes"), F.col("n_total") * 1.0, F.col("size_total")))


LLR = f"llr AS (SELECT mes, zone, score, n_nodes, {LLR_SQL} AS llr FROM (SELECT mes, zone, score, n_nodes, score::DOUBLE AS n_in, n_nodes::DOUBLE AS size_in, sum(score) OVER (PARTITION BY mes)::DOUBLE AS n_total, (SELECT count(*) FROM nodes)::DOUBLE AS size_total FROM zs))"


@query("poisson_llr", sql(f"WITH {ZS}, {LLR} SELECT mes, zone, round(llr, 6) AS llr FROM llr"))
def poisson_llr(spark, d):
    return scored(spark, d).select("mes", "zone", F.round("llr", 6).alias("llr"))



def by_score():
    return [F.desc("score"), F.col("zone")]


@query("select_fixed", sql(f"WITH {ZS} SELECT mes, zone, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY mes ORDER BY score DESC, zone) AS rank FROM zs QUALIFY rank <= 5"))
def select_fixed(spark, d):
    return selecting.select_fixed(zone_scores_of(spark, d), ["mes"], 5, by_score()).select("mes", "zone", "score", "rank")


@query("select_percentile", sql(f"WITH {ZS}, q AS (SELECT mes, quantile_cont(CAST(score AS DOUBLE), 0.9) AS threshold FROM zs GROUP BY mes) SELECT mes, zone, CAST(score AS BIGINT) AS score, round(threshold, 6) AS threshold FROM zs JOIN q USING (mes) QUALIFY (score >= threshold OR row_number() OVER (PARTITION BY mes ORDER BY score DESC, zone) <= 2) AND row_number() OVER (PARTITION BY mes ORDER BY score DESC, zone) <= 8"))
def select_percentile(spark, d):
    return selecting.select_percentile(zone_scores_of(spark, d), ["mes"], 0.9, by_score(), 2, 8).select("mes", "zone", "score", F.round("threshold", 6).alias("threshold"))


@query("select_montecarlo_given_null", sql(f"WITH {ZS}, {LLR}, nl AS (SELECT mes, ((b * 7919) % 97) / 10.0::DOUBLE AS value FROM (SELECT DISTINCT mes FROM zs), (SELECT unnest(range(1, 100)) AS b)) SELECT l.mes, l.zone, round((1 + (SELECT count(*) FROM nl WHERE nl.mes = l.mes AND nl.value >= l.llr)) / 100.0, 6) AS p_value, (1 + (SELECT count(*) FROM nl WHERE nl.mes = l.mes AND nl.value >= l.llr)) / 100.0 < 0.05 AS kept FROM llr l"))
def select_montecarlo_given_null(spark, d):
    z = scored(spark, d)
    null = z.select("mes").distinct().withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(99)))).select("mes", ((F.col("b") * 7919) % 97 / 10.0).alias("value"))
    return selecting.select_montecarlo(z, null, ["mes"], 0.05).select("mes", "zone", F.round("p_value", 6).alias("p_value"), "kept")


@query("null_summary", "SELECT brand, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS max FROM (SELECT p_brand AS brand, p_retailprice AS v FROM part) GROUP BY brand")
def null_summary(spark, d):
    v = F.col("p_retailprice")
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.max(v).alias("max"))


@query("footprint_series", sql("SELECT zone, mes, CAST(coalesce(sum(c), 0) AS BIGINT) AS c FROM (SELECT DISTINCT zone FROM nodes) CROSS JOIN (SELECT DISTINCT mes FROM counts) LEFT JOIN zone_counts USING (zone, mes) GROUP BY ALL"))
def footprint_series(spark, d):
    z = nodes(spark, d).select("node_id", "zone")
    months = counts(spark, d).select("mes").distinct()  # one row per month
    own = counts(spark, d).join(z, "node_id").groupBy("zone", "mes").agg(F.sum("c").alias("c"))
    return z.select("zone").distinct().crossJoin(F.broadcast(months)).join(own, ["zone", "mes"], "left").select("zone", "mes", F.coalesce("c", F.lit(0)).alias("c"))


def families(spark, d):
    z = scored(spark, d)
    w = lambda *o: Window.partitionBy("mes").orderBy(*o)
    a = z.withColumn("r", F.row_number().over(w(F.desc("score"), "zone"))).where("r <= 3").withColumn("method", F.lit("top"))
    b = z.withColumn("r", F.row_number().over(w("zone"))).where("r <= 3").withColumn("method", F.lit("first"))
    return a.unionByName(b)


FAM = "fam AS (SELECT *, 'top' AS method FROM llr QUALIFY row_number() OVER (PARTITION BY mes ORDER BY score DESC, zone) <= 3 UNION ALL SELECT *, 'first' FROM llr QUALIFY row_number() OVER (PARTITION BY mes ORDER BY zone) <= 3)"
TOT = "(SELECT mes, sum(c) AS total FROM counts GROUP BY mes)"


def month_totals(spark, d):
    return counts(spark, d).groupBy("mes").agg(F.sum("c").alias("total"))


def monthly(spark, d):
    size = nodes(spark, d).agg(F.count("*").alias("network"))
    return families(spark, d).join(month_totals(spark, d), "mes").crossJoin(F.broadcast(size)).groupBy("mes", "method").agg(F.sum("score").alias("captured"), F.sum("n_nodes").alias("nodes"), F.max("total").alias("total"), F.max("network").alias("network"))


@query("evaluate_monthly", sql(f"WITH {ZS}, {LLR}, {FAM} SELECT mes, method, CAST(sum(score) AS BIGINT) AS captured, CAST(sum(n_nodes) AS BIGINT) AS nodes, round(sum(score) / any_value(total), 5) AS coverage, round(sum(score) / sum(n_nodes), 4) AS density, round(sum(n_nodes) / (SELECT count(*) FROM nodes), 6) AS footprint FROM fam JOIN {TOT} USING (mes) GROUP BY mes, method"))
def evaluate_monthly(spark, d):
    m = monthly(spark, d)
    return m.select("mes", "method", "captured", "nodes", F.round(F.col("captured") / F.col("total"), 5).alias("coverage"), F.round(F.col("captured") / F.col("nodes"), 4).alias("density"), F.round(F.col("nodes") / F.col("network"), 6).alias("footprint"))


def totals(spark, d):
    return monthly(spark, d).groupBy("method").agg(F.sum("captured").alias("captured"), F.sum("nodes").alias("nodes"), F.sum("total").alias("total"), F.avg("nodes").alias("mean_nodes"), F.count("*").alias("months"), F.max("network").alias("network"))


@query("evaluate_totals", sql(f"WITH {ZS}, {LLR}, {FAM}, m AS (SELECT mes, method, sum(score) AS captured, sum(n_nodes) AS nodes, any_value(total) AS total FROM fam JOIN {TOT} USING (mes) GROUP BY mes, method) SELECT method, CAST(sum(captured) AS BIGINT) AS captured, CAST(sum(nodes) AS BIGINT) AS nodes, round(sum(captured) / sum(total), 5) AS coverage, round(sum(captured) / sum(nodes), 4) AS density, round(round(sum(captured) / sum(nodes), 4) / round(sum(total) / count(*) / (SELECT count(*) FROM nodes), 4), 4) AS lift FROM m GROUP BY method"))
def evaluate_totals(spark, d):
    t = totals(spark, d)
    dens, mean = F.round(F.col("captured") / F.col("nodes"), 4), F.round(F.col("total") / F.col("months") / F.col("network"), 4)
    return t.select("method", "captured", "nodes", F.round(F.col("captured") / F.col("total"), 5).alias("coverage"), dens.alias("density"), F.round(dens / mean, 4).alias("lift"))


@query("compare_methods", sql(f"WITH {ZS}, {LLR}, {FAM}, t AS (SELECT method, sum(score) AS captured, sum(n_nodes) AS nodes FROM fam GROUP BY method) SELECT b.method, CAST(a.captured - b.captured AS BIGINT) AS gain, CASE WHEN b.captured <> 0 THEN round((a.captured - b.captured) / b.captured, 6) END AS gain_rel, CASE WHEN b.nodes <> 0 THEN round((a.captured / a.nodes) / (b.captured / b.nodes), 6) END AS density_ratio FROM t a, t b WHERE a.method = 'top' AND b.method <> 'top'"))
def compare_methods(spark, d):
    t = totals(spark, d)
    a = t.where("method = 'top'").select(F.col("captured").alias("ca"), F.col("nodes").alias("na"))
    b = t.where("method <> 'top'").crossJoin(F.broadcast(a))
    return b.select("method", (F.col("ca") - F.col("captured")).alias("gain"), F.round(statistics.ratio(F.col("ca") - F.col("captured"), F.col("captured")), 6).alias("gain_rel"), F.round(statistics.ratio(F.col("ca") / F.col("na"), F.col("captured") / F.col("nodes")), 6).alias("density_ratio"))


@query("evaluation_rollup", sql(f"WITH {ZS}, {LLR}, {FAM} SELECT coalesce(mes, 'all') AS mes, method, CAST(sum(score) AS BIGINT) AS captured FROM fam GROUP BY GROUPING SETS ((mes, method), (method))"))
def evaluation_rollup(spark, d):
    return families(spark, d).rollup("method", "mes").agg(F.sum("score").alias("captured")).where("method is not null").select(F.coalesce("mes", F.lit("all")).alias("mes"), "method", "captured")


GRID = "(SELECT DISTINCT p_brand AS brand, CAST(p_size AS DOUBLE) AS coverage, round(p_retailprice / 100, 1) AS density FROM part)"


def grid(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("coverage"), F.round(F.col("p_retailprice") / 100, 1).alias("density")).distinct()


PARETO = f"front AS (SELECT a.* FROM {GRID} a WHERE NOT EXISTS (SELECT 1 FROM {GRID} b WHERE b.brand = a.brand AND b.coverage >= a.coverage AND b.density >= a.density AND (b.coverage > a.coverage OR b.density > a.density)))"


@query("pareto_front", f"WITH {PARETO} SELECT * FROM front")
def pareto_front(spark, d):
    return selecting.pareto(grid(spark, d), ["brand"], "coverage", "density")


@query(
    "knee_point",
    f"""WITH {PARETO}, n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY brand ORDER BY coverage, density DESC) - 1 AS i, (coverage - min(coverage) OVER w) / nullif(max(coverage) OVER w - min(coverage) OVER w, 0) AS x, (density - min(density) OVER w) / nullif(max(density) OVER w - min(density) OVER w, 0) AS y FROM front WINDOW w AS (PARTITION BY brand)),
    e AS (SELECT brand, arg_min(x, i) AS x0, arg_min(y, i) AS y0, arg_max(x, i) AS x1, arg_max(y, i) AS y1 FROM n GROUP BY brand),
    o AS (SELECT n.*, CASE WHEN n < 3 OR x IS NULL OR y IS NULL THEN 0.0 ELSE round(abs((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0)) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 9) END AS curvature, CASE WHEN n < 3 THEN i = n - 1 WHEN x IS NULL OR y IS NULL THEN i = n // 2 ELSE false END AS forced FROM n JOIN e USING (brand))
    SELECT brand, coverage, density, round(curvature, 6) AS curvature FROM o QUALIFY row_number() OVER (PARTITION BY brand ORDER BY forced DESC, curvature DESC, i) = 1""",
)
def knee_point(spark, d):
    return selecting.knee(selecting.pareto(grid(spark, d), ["brand"], "coverage", "density"), ["brand"], "coverage", "density").withColumn("curvature", F.round("curvature", 6))


@query("alpha_sensitivity", f"SELECT brand, coverage, CASE WHEN count(*) < 2 OR max(density) = 0 THEN 0.0 ELSE round((max(density) - min(density)) / max(density), 6) END AS spread FROM {GRID} GROUP BY brand, coverage")
def alpha_sensitivity(spark, d):
    hi, lo = F.max("density"), F.min("density")
    return grid(spark, d).groupBy("brand", "coverage").agg(F.when((F.count("*") < 2) | (hi == 0), 0.0).otherwise(F.round((hi - lo) / hi, 6)).alias("spread"))


@query("month_subsample", sql("WITH m AS (SELECT mes, row_number() OVER (ORDER BY mes) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT mes FROM counts)), k AS (SELECT DISTINCT CAST(floor(j * n / 6.0) AS BIGINT) AS i FROM m, (SELECT unnest(range(0, 6)) AS j)) SELECT mes FROM m JOIN k USING (i)"))
def month_subsample(spark, d):
    months = counts(spark, d).select("mes").distinct()
    ranked = months.withColumn("i", F.row_number().over(Window.orderBy("mes")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))  # one row per month
    picks = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.floor(j * F.col("n") / 6.0))
    return ranked.where(F.array_contains(picks, F.col("i").cast("long"))).select("mes")


# operators without an equivalent in SQL; their properties are tested


def segmented(spark, d, alpha: float = 0.15, floor: float = 0.2):
    return regions.segment(density(spark, d), network.both_ways(edges(spark, d)), ["mes"], alpha, floor)


@query("segment_regions")
def segment_regions(spark, d):
    return segmented(spark, d)


@query("extract_hotspots")
def extract_hotspots(spark, d):
    return regions.hotspots(segmented(spark, d), counts(spark, d), ["mes"]).where("rank <= 20").withColumn("id", F.concat_ws("_h", "mes", F.lpad(F.col("rank").cast("string"), 2, "0")))


@query("baseline_greedy")
def baseline_greedy(spark, d):
    return regions.grown(counts(spark, d), network.both_ways(edges(spark, d)), ["mes"], 20, 18)


@query("baseline_bfs")
def baseline_bfs(spark, d):
    return regions.grown(counts(spark, d), network.both_ways(edges(spark, d)), ["mes"], 20, 18, "bfs")


def null_maxima(spark, d, replicates: int = 99, permute: bool = False):
    """The highest log likelihood ratio of each replicate's regions. Replicates drawn anew are one task's arrays each; permuted ones, and those of networks too large for that, are rows, some dozens of a month swept
    in a task."""
    n = nodes(spark, d).select("node_id", F.col("node_id").alias("idx"))
    if not permute:
        found = regions.null_highest(counts(spark, d), n, network.both_ways(edges(spark, d)), reach(spark, d), ["mes"], replicates, 7, SIGMA, 0.15, 0.2)
        if found is not None:
            return found.withColumn("value", F.round("value", 6))
    drawn = storage.saved(regions.null_counts(counts(spark, d), n, ["mes"], replicates, 7, permute), "null")
    by = ["mes", "replicate"]
    block = F.floor(F.col("replicate") / 25).alias("block")
    f = fields.density_field(drawn, distances(spark, d), SIGMA, by)
    found = regions.segment(f.select("*", block), network.both_ways(edges(spark, d)), by, 0.15, 0.2, ["mes", "block"])
    scored = found.join(drawn, [*by, "node_id"], "left").groupBy(*by, "peak").agg(F.sum("c").alias("score"), F.count("*").alias("n_nodes"))
    total = drawn.groupBy(*by).agg(F.sum("c").alias("n_total"))
    size = nodes(spark, d).agg(F.count("*").alias("size_total"))
    llr = statistics.poisson_llr(F.col("score") * 1.0, F.col("n_nodes"), F.col("n_total") * 1.0, F.col("size_total"))
    return scored.where("score > 0").join(total, by).crossJoin(F.broadcast(size)).groupBy(*by).agg(F.round(F.max(llr), 6).alias("value"), F.max("n_total").alias("n_total"))


@query("montecarlo_null")
def montecarlo_null(spark, d):
    return null_maxima(spark, d)


@query("montecarlo_null_permutation")
def montecarlo_null_permutation(spark, d):
    return null_maxima(spark, d, permute=True)


SIGMAS, ALPHAS, FLOORS, KS = [60.0, 80.0, 100.0, 110.0, 115.0, 120.0], [0.05, 0.1, 0.2, 0.3, 0.5], [0.02, 0.05, 0.1, 0.15, 0.2, 0.3], [5, 10, 15, 20, 30, 50]


def swept(spark, d, sigmas=SIGMAS, alphas=ALPHAS, floors=FLOORS, ks=KS):
    """The grid of all parameters on all months: one row each for sigma, alpha, f_min and k. The kernel, of the widest reach, serves every sigma."""
    own, near = counts(spark, d), reach(spark, d)
    return selecting.swept(own, near, network.both_ways(edges(spark, d)), nodes(spark, d).count(), sigmas, alphas, floors, ks)


@query("parameter_sweep")
def parameter_sweep(spark, d):
    """Coverage, density and lift of the first 20 regions of every month at 180 points of sigma, alpha and floor, and of other numbers of regions at the middle one."""
    middle = F.expr(f"sigma = {SIGMAS[len(SIGMAS) // 2]} and alpha = {ALPHAS[len(ALPHAS) // 2]} and f_min = {FLOORS[len(FLOORS) // 2]}")
    return swept(spark, d).where((F.col("k") == 20) | middle)


@query("calibrate")
def calibrate(spark, d):
    """The Pareto front of the sweep, its knee and how much alpha matters there."""
    return selecting.calibrated(swept(spark, d, ks=[20]))
