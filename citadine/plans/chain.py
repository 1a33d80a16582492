"""The chain from incidents to reports on the lattice: hotspots, their evaluation, descriptors, similarity, places, trajectories, contrasts and the benchmark with known truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from citadine import storage
from citadine.operators import chain, embedding, network, paths, regions
from citadine.operators import field as fields
from citadine.plans.regions import SIGMA, null_maxima, segmented
from citadine.plans.registry import query
from citadine.plans.surrogate import counts, edges, incidents, nodes, pois

ROADS = ["highway", "avenue", "street", "lane"]
KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def roads(spark, d):
    names = F.array(*[F.lit(r) for r in ROADS])
    return edges(spark, d).withColumn("road_class", F.element_at(names, (F.col("u") % 4 + 1).cast("int")))


def kinds(spark, d):
    return incidents(spark, d).groupBy("mes", "node_id", "tipo").agg(F.count("*").alias("c"))


def arcs(spark, d):
    return network.both_ways(edges(spark, d))


def hotspots(spark, d, method="fixed", **options):
    own = counts(spark, d)
    parameters = {"method": method, **{k: v for k, v in options.items() if k != "null_max"}, "replicates": 19, "alpha": 0.15, "floor": 0.2, "sigma": SIGMA}
    build = lambda: chain.records(segmented(spark, d), own, kinds(spark, d), edges(spark, d), nodes(spark, d).count(), method, **(options or {"k": 20}))
    return storage.cached(spark, "hotspot-records", parameters, [own, edges(spark, d)], build)


@query("hotspot_records")
def hotspot_records(spark, d):
    return hotspots(spark, d).withColumn("by_category", F.sort_array(F.map_entries("by_category")))


@query("hotspot_records_percentile")
def hotspot_records_percentile(spark, d):
    return hotspots(spark, d, "percentile", q=0.9, min_k=1, max_k=50).drop("by_category")


@query("hotspot_records_montecarlo")
def hotspot_records_montecarlo(spark, d):
    null = null_maxima(spark, d, 19).select("mes", "value")
    return hotspots(spark, d, "montecarlo", null_max=null, alpha=0.06, min_k=1, max_k=50).drop("by_category")


@query("hotspots_observed")
def hotspots_observed(spark, d):
    return chain.observed(hotspots(spark, d))


def months(spark, d):
    own = counts(spark, d)
    return chain.monthly(storage.saved(chain.families(hotspots(spark, d), own, arcs(spark, d)), "families"), own)


@query("evaluation_monthly")
def evaluation_monthly(spark, d):
    return months(spark, d)


@query("evaluation_compared")
def evaluation_compared(spark, d):
    return chain.compared(months(spark, d))


def shapes(spark, d):
    return chain.shapes(hotspots(spark, d), nodes(spark, d), roads(spark, d))


@query("hotspot_descriptors")
def hotspot_descriptors(spark, d):
    return chain.described(*shapes(spark, d))


@query("hotspot_similarity")
def hotspot_similarity(spark, d):
    rows = chain.blocks(*shapes(spark, d), ROADS, "netlsd", dimensions=32)
    vectors = storage.saved(chain.fused(rows, {"structural": 1.0, "embedding": 1.0, "hierarchy": 0.5}), "vectors")
    return chain.similar(vectors, hotspots(spark, d), 5)


@query("hotspot_clusters")
def hotspot_clusters(spark, d):
    rows = chain.blocks(*shapes(spark, d), ROADS, "scattering", dimensions=16)
    vectors = storage.saved(chain.fused(rows, {"structural": 1.0, "embedding": 1.0, "hierarchy": 0.5}), "vectors")
    return embedding.clustered(vectors, "id", "vector", 5).join(embedding.pca(vectors, "id", "vector", 2), "id")


def profiles(spark, d):
    own, _ = shapes(spark, d)
    named = pois(spark, d).select("x", "y", F.substring_index("category", " ", 1).alias("category"), "year")
    return chain.place_profiles(hotspots(spark, d), own, named, KINDS, nodes(spark, d).count())


@query("hotspot_places")
def hotspot_places(spark, d):
    return profiles(spark, d)


@query("hotspot_archetypes")
def hotspot_archetypes(spark, d):
    return chain.archetypes(hotspots(spark, d), chain.blocks(*shapes(spark, d), ROADS, "netlsd", dimensions=8))


@query("hotspot_pair")
def hotspot_pair(spark, d):
    """The first hotspot of the first month against that of the last one."""
    ends = hotspots(spark, d).where("id like '%_h01'").agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    named = [r["mes"] for r in counts(spark, d).select("mes").distinct().orderBy("mes").collect()]  # one row per month
    return chain.pair(hotspots(spark, d), profiles(spark, d), KINDS, named, ends["a"], ends["b"])


def tracks(spark, d):
    return chain.trajectories(hotspots(spark, d), counts(spark, d))


@query("hotspot_trajectories")
def hotspot_trajectories(spark, d):
    n = counts(spark, d).agg(F.count_distinct("mes")).first()[0]
    return chain.trajectory_metrics(tracks(spark, d), hotspots(spark, d), arcs(spark, d), n)


def frequencies(spark, d):
    t = tracks(spark, d)
    n = counts(spark, d).agg(F.count_distinct("mes")).first()[0]
    return t.join(t.groupBy("traj_id").agg((F.count_distinct("mes") / F.lit(n)).alias("frequency")), "traj_id").select("id", "frequency")


@query("hotspot_contrast")
def hotspot_contrast(spark, d):
    return chain.contrasted(chain.described(*shapes(spark, d)), chain.thirds(frequencies(spark, d)))


@query("hotspot_matched_pairs")
def hotspot_matched_pairs(spark, d):
    from citadine.operators import tracking

    rows = chain.blocks(*shapes(spark, d), ROADS, "netlsd", dimensions=8)
    found = chain.matched_candidates(rows, hotspots(spark, d), min_ratio=2.0)
    return tracking.capped_pairs(found.drop("overlap"))


@query("synthetic_benchmark")
def synthetic_benchmark(spark, d):
    """Ten realisations of known clusters on a crop of the lattice: positive predictive value, sensitivity and F1 of extracted and grown regions of the same number and size."""
    inside = paths.crop(arcs(spark, d).select("src", "dst"), 0, 400).select("node_id")
    crop = edges(spark, d).join(F.broadcast(inside.withColumnRenamed("node_id", "u")), "u", "left_semi").join(F.broadcast(inside.withColumnRenamed("node_id", "v")), "v", "left_semi")
    scores = storage.saved(benchmark(storage.saved(crop, "crop"), 10), "scores")
    return chain.benchmark_stats(scores)


def benchmark(crop, realisations: int, sigma: float = SIGMA, alpha: float = 0.3, floor: float = 0.1, k: int = 20, **sown):
    both = network.both_ways(crop)
    own, truth = chain.clustered_incidents(crop, realisations, **sown)
    own = storage.saved(own, "synthetic")
    near = fields.stored_kernel(both, 3 * sigma, 80.0)
    size = both.select("src").distinct().count()
    found = regions.segment(fields.density_field(own, near, sigma, ["mes"]), both, ["mes"], alpha, floor)
    spots = chain.records(found, own, own.withColumn("tipo", F.lit("synthetic")), crop, size, "fixed", k=k)
    per = spots.groupBy("mes").agg(F.count("*").cast("int").alias("k"), F.greatest(F.lit(1), F.bround(F.avg("n_nodes"))).cast("int").alias("budget"))
    sized = own.join(per, "mes")
    detected = chain.members(spots).select("mes", F.lit("topo").alias("method"), "node_id")
    for growth in ("greedy", "bfs"):
        detected = detected.unionByName(regions.grown(sized, both, ["mes"], "k", "budget", growth).select("mes", F.lit(growth).alias("method"), "node_id"))
    return chain.scored(detected, truth)


