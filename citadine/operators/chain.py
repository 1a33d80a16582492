"""The steps from regions to what is reported, on tables keyed by hotspot: records, evaluation against grown regions, descriptors, places, similarity, trajectories and contrasts.

A table of hotspots has one row per hotspot and its nodes as an array; a corpus has some thousands, whatever the number of incidents. No count reaches what similarity is computed from:
``shapes`` takes nodes, coordinates and edges only.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine import storage
from citadine.functions.spatial import hull, segment_distance
from citadine.functions.statistics import entropy_term, location_quotient, poisson_llr
from citadine.operators import describing, embedding, network, paths, regions, selecting, tracking



def _ranked() -> list[Column]:
    return [F.desc("score"), F.desc("peak_f"), F.col("peak")]


def with_llr(found: DataFrame, counts: DataFrame, network_nodes: int) -> DataFrame:
    """Regions with the log likelihood ratio of their incidents by their share of the network's nodes."""
    total = counts.groupBy("mes").agg(F.sum("c").alias("n_total"))
    llr = poisson_llr(F.col("score") * 1.0, F.col("n_nodes") * 1.0, F.col("n_total") * 1.0, F.lit(float(network_nodes)))
    return found.join(total, "mes").withColumn("llr", llr)


def records(found: DataFrame, counts: DataFrame, kinds: DataFrame, edges: DataFrame, network_nodes: int, method: str = "fixed", **options) -> DataFrame:
    """The chosen regions of every month: id, mes, nodes, edges, crimes, by_category, seed_node, peak_node, peak_f, persistence, llr, p_value, n_nodes, density, series, candidates.

    ``found`` are regions by node, ``kinds`` counts by mes, node_id and tipo. The series are the incidents on the hotspot's nodes in each month of the data, in order."""
    scored = with_llr(regions.hotspots(found, counts, ["mes"]), counts, network_nodes).drop("rank")
    scored = scored.withColumn("candidates", F.count("*").over(Window.partitionBy("mes")))
    kept = selecting.resolve(method, scored, ["mes"], _ranked(), **options)
    if "p_value" not in kept.columns:
        kept = kept.withColumn("p_value", F.lit(None).cast("double"))
    rank = F.row_number().over(Window.partitionBy("mes").orderBy(*_ranked()))
    kept = storage.saved(kept.withColumn("id", F.concat(F.col("mes"), F.lit("_h"), F.lpad(rank.cast("string"), 2, "0"))), "hotspots")
    own = members(kept)
    by_kind = own.join(kinds, ["mes", "node_id"]).groupBy("id", "tipo").agg(F.sum("c").cast("long").alias("c"))
    maps = by_kind.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tipo", "c")))).alias("by_category"))
    inner = network.induced_edges(edges.select("u", "v"), own.select("id", "node_id"), ["id"])
    lists = inner.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))).alias("edges"))
    out = kept.join(maps, "id", "left").join(lists, "id", "left").join(series(own, counts), "id", "left")
    return out.select(
        "id", "mes", "nodes", F.coalesce("edges", F.array().cast("array<struct<u:bigint,v:bigint>>")).alias("edges"), F.col("score").alias("crimes"), "by_category", "seed_node", F.col("peak").alias("peak_node"),
        F.round("peak_f", 6).alias("peak_f"), F.round("persistence", 6).alias("persistence"), F.round("llr", 4).alias("llr"), F.round("p_value", 6).alias("p_value"), "n_nodes", F.round("density", 4).alias("density"), "series", "candidates",
    )


def members(spots: DataFrame) -> DataFrame:
    """id, mes and node_id. Joins with them are merges: the size of a table of arrays says nothing of how many rows their explosion gives, and must not choose a broadcast."""
    return spots.select("id", "mes", F.explode("nodes").alias("node_id")).hint("merge")


def series(own: DataFrame, counts: DataFrame) -> DataFrame:
    """id and its nodes' incidents in every month of the data."""
    months = counts.select("mes").distinct().agg(F.sort_array(F.collect_list("mes")).alias("months"))  # one row per month
    each = own.select("id", "node_id").join(counts, "node_id").groupBy("id", "mes").agg(F.sum("c").cast("long").alias("c"))
    maps = own.select("id").distinct().join(each, "id", "left").groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("mes").isNotNull(), F.struct("mes", "c")))).alias("m"))
    return maps.crossJoin(F.broadcast(months)).select("id", F.transform("months", lambda m: F.coalesce(F.element_at("m", m), F.lit(0).cast("long"))).alias("series"))


def observed(spots: DataFrame) -> DataFrame:
    """How many hotspots the months have: least, most and mean, and the mean of their candidates."""
    per = spots.groupBy("mes").agg(F.count("*").alias("n"), F.first("candidates").alias("candidates"))
    return per.agg(F.min("n").alias("hotspots_min"), F.max("n").alias("hotspots_max"), F.round(F.avg("n"), 2).alias("hotspots_mean"), F.round(F.avg("candidates"), 1).alias("candidates_mean"))


# evaluation


def families(spots: DataFrame, counts: DataFrame, arcs: DataFrame, match_footprint: bool = True, node_budget: int = 18) -> DataFrame:
    """Extracted and grown hotspots by month: mes, method, captured, nodes, hotspots, budget. The grown ones are as many, and as large on average, as the month's extracted ones, so what they capture differs by
    where they are."""
    own = spots.groupBy("mes").agg(F.count("*").cast("int").alias("k"), F.greatest(F.lit(1), F.bround(F.avg("n_nodes"))).cast("int").alias("mean"), F.sum("crimes").alias("captured"), F.sum("n_nodes").alias("nodes"))
    sized = counts.join(own.select("mes", "k", (F.col("mean") if match_footprint else F.lit(node_budget)).cast("int").alias("budget")), "mes")
    out = own.select("mes", F.lit("topo").alias("method"), "captured", "nodes", F.col("k").cast("long").alias("hotspots"))
    network_ = regions.spread(arcs) or arcs
    for growth in ("greedy", "bfs"):
        each = regions.grown(sized, network_, ["mes"], "k", "budget", growth).groupBy("mes").agg(F.sum("c").alias("captured"), F.count("*").alias("nodes"), F.count_distinct("rank").alias("hotspots"))
        out = out.unionByName(each.withColumn("method", F.lit(growth)))
    return out.join(sized.select("mes", "budget").distinct(), "mes")


def monthly(families_: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per month and method with coverage and density, and what the extracted ones capture more (gain, coverage_points)."""
    total = counts.groupBy("mes").agg(F.sum("c").alias("crimes"))
    rows = families_.join(total, "mes").withColumn("share", F.coalesce(F.try_divide("captured", "crimes"), F.lit(0.0)))
    topo = rows.where("method = 'topo'").select("mes", F.col("captured").alias("tc"), F.col("share").alias("ts"))
    rows = rows.join(topo, "mes")
    return rows.select(
        "mes", "method", "crimes", "captured", F.round("share", 5).alias("coverage"), "nodes", F.round(F.coalesce(F.try_divide("captured", "nodes"), F.lit(0.0)), 4).alias("density"), "hotspots", "budget",
        (F.col("tc") - F.col("captured")).alias("gain"), F.round((F.col("ts") - F.col("share")) * 100, 3).alias("coverage_points"),
    )


def compared(months: DataFrame) -> DataFrame:
    """One row per method over all months (ratios of sums), with the extracted ones' gain over it; null where there is nothing to divide by."""
    t = months.groupBy("method").agg(*[F.sum(c).alias(c) for c in ("captured", "crimes", "nodes", "hotspots")])
    t = t.withColumns({"cov": F.coalesce(F.try_divide("captured", "crimes"), F.lit(0.0)), "den": F.coalesce(F.try_divide("captured", "nodes"), F.lit(0.0))})
    topo = t.where("method = 'topo'").select(*[F.col(c).alias(f"t_{c}") for c in ("captured", "nodes", "cov", "den")])
    gain = F.col("t_captured") - F.col("captured")
    return t.crossJoin(F.broadcast(topo)).select(
        "method", "captured", F.round("cov", 5).alias("coverage"), "nodes", F.round("den", 4).alias("density"), "hotspots", gain.alias("gain_absolute"), F.round(F.try_divide(gain, F.col("captured")), 5).alias("gain_relative"),
        F.round((F.col("t_cov") - F.col("cov")) * 100, 3).alias("coverage_points"), F.round(F.col("t_den") - F.col("den"), 4).alias("density_delta"),
        (F.col("t_nodes") - F.col("nodes")).alias("footprint_delta"), F.round(F.try_divide("t_nodes", "nodes"), 4).alias("footprint_ratio"),
    )


# descriptors


def shapes(spots: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each hotspot the nodes with their metres (id, node_id, x, y) and the edges (id, u, v, road_class); no counts."""
    own = storage.saved(members(spots).select("id", "node_id").join(nodes.select("node_id", "x", "y"), "node_id").select("id", "node_id", "x", "y"), "shape-nodes")
    inner = network.induced_edges(edges.select("u", "v", "road_class"), own.select("id", "node_id"), ["id"])
    return own, storage.saved(inner.select("id", "u", "v", "road_class"), "shape-edges")


def both_ways(inner: DataFrame) -> DataFrame:
    return inner.select("id", F.col("u").alias("src"), F.col("v").alias("dst"), "road_class").unionByName(inner.select("id", F.col("v").alias("src"), F.col("u").alias("dst"), "road_class"))


STRUCTURE = ["log_nodes", "log_edges", "density", "mean_degree", "degree_1", "degree_2", "degree_3", "degree_4", "gyration", "elongation", "edge_mean", "edge_cv"]


def blocks(own: DataFrame, inner: DataFrame, classes: list[str], method: str = "graph2vec", **options) -> DataFrame:
    """id and the three blocks that similarity is of, as arrays: structural (scaled to [0, 1]), embedding and hierarchy."""
    s = describing.minmax(describing.structural(own, inner, "id"), STRUCTURE).select("id", F.array(*STRUCTURE).alias("structural"))
    shares = [*classes, "dominance"]
    h = describing.hierarchy(inner, "id", classes).select("id", F.array(*shares).alias("hierarchy"))
    e = embedding.embedded(method, own, both_ways(inner), "id", classes=classes, **options).select("id", F.col("vector").alias("embedding"))
    zeros = F.array(*[F.lit(0.0)] * len(shares))
    return storage.saved(s.join(e, "id").join(h, "id", "left").withColumn("hierarchy", F.coalesce("hierarchy", zeros)), "blocks")


def fused(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """id and vector: each block standardised by column over all rows, times its weight over the root of its length, one after the other."""
    out = rows.select("id")
    for name, weight in weights.items():
        long = rows.select("id", F.posexplode(name).alias("dim", "v"))
        scaled = describing.zscores(long, "dim", "v")
        whole = scaled.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("x"))
        out = out.join(whole.select("id", F.transform("x", lambda v: v * F.lit(float(weight)) / F.sqrt(F.size("x"))).alias(f"b_{name}")), "id")
    return out.select("id", F.concat(*[F.col(f"b_{name}") for name in weights]).alias("vector"))


def similar(vectors: DataFrame, spots: DataFrame, k: int) -> DataFrame:
    """The k most similar hotspots of each, over all and over those at another place (no node in common): a, b, similarity, jaccard, distinct."""
    rows = vectors.join(spots.select("id", "nodes"), "id")
    everywhere = embedding.nearest(rows, "id", "vector", k).withColumn("distinct", F.lit(False))
    elsewhere = embedding.nearest(rows, "id", "vector", k, apart="nodes").withColumn("distinct", F.lit(True))
    side = lambda x: spots.select(F.col("id").alias(x), F.col("nodes").alias(f"n{x}"))
    pairs = everywhere.unionByName(elsewhere).join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("na", "nb"))
    return pairs.select("a", "b", F.round("similarity", 5).alias("similarity"), F.round(shared / (F.size("na") + F.size("nb") - shared), 4).alias("jaccard"), "distinct")


# places


def hulls(own: DataFrame) -> DataFrame:
    """id and the corners of the convex hull of its nodes, counter-clockwise; one or two for those on a point or a line."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [frame["id"].iloc[0]], "corners": [[{"x": x, "y": y} for x, y in hull(list(zip(frame["x"].tolist(), frame["y"].tolist())))]]})

    return own.groupBy("id").applyInPandas(run, "id string, corners array<struct<x:double,y:double>>")


def inside(corners: DataFrame, points: DataFrame, buffer: float, side: float = 500.0) -> DataFrame:
    """id and the points' columns of the points (x, y) that lie in a hull or nearer than ``buffer`` to it. Hulls are dealt to the cells of a grid that they and their margin touch, points to their own.
    The join is a merge: neither side's file says how many rows it holds."""
    lo = lambda a: F.array_min(F.transform("corners", lambda p: p[a])) - buffer
    hi = lambda a: F.array_max(F.transform("corners", lambda p: p[a])) + buffer
    cells = lambda a: F.sequence(F.floor(lo(a) / side), F.floor(hi(a) / side))
    dealt = corners.withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y")))
    placed = points.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    near = placed.join(dealt.hint("merge"), ["cx", "cy"])
    n = F.size("corners")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col("corners")[i].alias("a"), F.col("corners")[(i + 1) % n].alias("b")))
    left = F.forall(sides, lambda s: (s["b"]["x"] - s["a"]["x"]) * (F.col("y") - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (F.col("x") - s["a"]["x"]) > 0)
    away = F.array_min(F.transform(sides, lambda s: segment_distance(F.col("x"), F.col("y"), s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))
    return near.where(((n > 2) & left) | (away < buffer)).drop("cx", "cy", "corners")


def place_profiles(spots: DataFrame, own: DataFrame, pois: DataFrame, categories: list[str], network_nodes: int, buffer: float = 50.0) -> DataFrame:
    """One row per hotspot: counts and lq (location quotients) by category in their order, total, per_node, entropy, entropy_norm, year.

    ``pois`` has x, y, category and year. A hotspot is held against the snapshot nearest to its own year, the earlier of two; without years, against all. Points of unknown categories don't count."""
    known = pois.where(F.col("category").isin(categories))
    years = pois.where("year is not null").select(F.col("year").alias("snapshot")).distinct()  # one row per snapshot
    base = spots.select("id", "n_nodes", F.substring("mes", 1, 4).cast("int").alias("own"))
    base = base.join(F.broadcast(years), F.lit(True), "left").groupBy("id", "n_nodes").agg(F.min_by("snapshot", F.struct(F.abs(F.col("snapshot") - F.col("own")), "snapshot")).alias("year"))
    city = known.groupBy("category", F.col("year").alias("cy")).agg(F.count("*").alias("city"))
    found = inside(hulls(own), known.select("x", "y", "category", F.col("year").alias("py")), buffer).join(base.select("id", "year"), "id").where(F.col("py").eqNullSafe(F.col("year")))
    cells = found.groupBy("id", "category").agg(F.count("*").alias("c"))
    every = base.join(F.broadcast(base.sparkSession.createDataFrame([(c, i) for i, c in enumerate(categories)], "category string, i int")), F.lit(True))
    full = every.join(cells, ["id", "category"], "left").join(city, (city["category"] == every["category"]) & F.col("cy").eqNullSafe(F.col("year")), "left").drop(city["category"]).fillna(0, ["c", "city"])
    full = full.withColumn("lq", location_quotient(F.col("c"), F.col("city"), F.col("n_nodes"), F.lit(network_nodes))).withColumn("t", F.sum("c").over(Window.partitionBy("id")))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda s: s[c])
    h = F.sum(entropy_term(F.col("c"), F.col("t")))
    out = full.groupBy("id", "n_nodes", "year").agg(in_order("c").alias("counts"), in_order("lq").alias("lq"), F.max("t").alias("total"), F.coalesce(h, F.lit(0.0)).alias("entropy"))
    k = max(2, len(categories))
    return out.select("id", "year", "counts", "lq", "total", (F.col("total") / F.col("n_nodes")).alias("per_node"), "entropy", (F.col("entropy") / math.log(k)).alias("entropy_norm"))


# trajectories


def trajectories(spots: DataFrame, counts: DataFrame, least: float = 0.2, max_gap: int = 3) -> DataFrame:
    """traj_id, seq, id, mes, iou of every hotspot; months are those of the data, so a month without hotspots is a gap."""
    months = counts.select("mes").distinct().withColumn("t", F.row_number().over(Window.orderBy("mes")) - 1)  # one row per month
    timed = spots.join(F.broadcast(months), "mes")
    pairs = tracking.overlaps(timed.select("t", "id", F.explode("nodes").alias("node_id")), "t", "id", "node_id", max_gap, least)
    return storage.saved(tracking.linked(timed.select("id", "t", "mes"), pairs, max_gap), "trajectories")


def steps(pairs: DataFrame, arcs: DataFrame, cutoff: float) -> DataFrame:
    """a, b and the metres between them along the network, ``cutoff`` where it is farther or one is not on it. Each task searches from the nodes of its pairs in the network, a broadcast of checked size."""
    if arcs.count() > regions.MOST_ARCS:
        raise ValueError(f"more than {regions.MOST_ARCS} arcs; split the network into districts")
    shared = arcs.sparkSession.sparkContext.broadcast(regions.packed(arcs.groupBy("src", "dst").agg(F.min("length").alias("length"))))

    def away(a: int, b: int) -> float:
        net, length = shared.value.network, shared.value.lengths
        start, end = net.places(np.array([a, b])).tolist()
        if a == b or min(start, end) < 0:
            return 0.0 if start >= 0 and a == b else cutoff
        done, ahead = set(), [(0.0, start)]
        while ahead:
            d, v = heapq.heappop(ahead)
            if v == end:
                return d
            if v in done:
                continue
            done.add(v)
            for i in range(net.start[v], net.start[v + 1]):
                u = int(net.to[i])
                if u not in done and d + length[i] <= cutoff:
                    heapq.heappush(ahead, (d + float(length[i]), u))
        return cutoff

    def run(batches):
        for frame in batches:
            yield frame.assign(metres=[away(a, b) for a, b in zip(frame["a"], frame["b"])])

    return pairs.select("a", "b").distinct().mapInPandas(run, "a long, b long, metres double")


def trajectory_metrics(tracks: DataFrame, spots: DataFrame, arcs: DataFrame, n_months: int, cutoff: float = 3000.0) -> DataFrame:
    """One row per trajectory: members, months, crimes, k, frequency, intensity_mean, intensity_max, density_mean, nodes_mean, nodes_union, stability and movement_m (null for a single appearance)."""
    own = tracks.join(spots.drop("mes"), "id")
    before = F.lag("seed_node").over(Window.partitionBy("traj_id").orderBy("seq"))
    moves = storage.saved(own.select("traj_id", "seq", before.alias("a"), F.col("seed_node").alias("b")).where("a is not null"), "moves")
    moved = moves.join(steps(moves, arcs, cutoff), ["a", "b"]).groupBy("traj_id").agg(F.avg("metres").alias("movement_m"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("seq", c))), lambda s: s[c])
    union = F.size(F.array_distinct(F.flatten(F.collect_list("nodes"))))
    out = own.groupBy("traj_id").agg(
        listed("id").alias("members"), listed("mes").alias("months"), listed("crimes").alias("crimes"), F.count("*").alias("k"), (F.count_distinct("mes") / F.lit(n_months)).alias("frequency"),
        F.avg("crimes").alias("intensity_mean"), F.max("crimes").alias("intensity_max"), F.avg("density").alias("density_mean"), F.avg("n_nodes").alias("nodes_mean"), union.alias("nodes_union"), F.avg("iou").alias("stability"),
    )
    return out.join(moved, "traj_id", "left")


# contrasts


def described(own: DataFrame, inner: DataFrame) -> DataFrame:
    """id, name, value: the twelve scaled descriptors, mean betweenness and closeness, and crossings per kilometre."""
    s = describing.minmax(describing.structural(own, inner, "id"), STRUCTURE)
    c = paths.centrality(own.select("id", "node_id"), both_ways(inner).select("id", "src", "dst"), "id")
    xy = lambda p: own.select("id", F.col("node_id").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    km = inner.join(xy("u"), ["id", "u"]).join(xy("v"), ["id", "v"]).groupBy("id").agg((F.sum(F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))) / 1000).alias("km"))
    crossings = both_ways(inner).groupBy("id", "src").agg(F.count("*").alias("deg")).groupBy("id").agg(F.count_if(F.col("deg") >= 3).alias("n"))
    rate = own.select("id").distinct().join(km, "id", "left").join(crossings, "id", "left").select("id", F.coalesce(F.try_divide("n", "km"), F.lit(0.0)).alias("intersection_density_km"))
    wide = s.join(c, "id").join(rate, "id").withColumnsRenamed({"betweenness": "betweenness_mean", "closeness": "closeness_mean"})
    return wide.unpivot("id", [x for x in wide.columns if x != "id"], "name", "value")


def thirds(frequencies: DataFrame) -> DataFrame:
    """id and group: a for the upper third by frequency, b for the lower one; a hotspot of both, where they are equal, has a row for each."""
    at = frequencies.agg(F.percentile("frequency", F.lit(1 / 3)).alias("lo"), F.percentile("frequency", F.lit(2 / 3)).alias("hi"))
    rows = frequencies.crossJoin(F.broadcast(at))
    return rows.where("frequency >= hi").select("id", F.lit("a").alias("grp")).unionByName(rows.where("frequency <= lo").select("id", F.lit("b").alias("grp")))


def contrasted(values: DataFrame, groups: DataFrame) -> DataFrame:
    """For each name: means of both groups (0 for an empty one), Cliff's delta, U, p, p_adj and rank by the size of delta. ``values`` has id, name, value."""
    rows = storage.saved(values.join(groups, "id").withColumn("value", F.col("value").cast("double")), "contrast")
    mean = lambda g: F.coalesce(F.avg(F.when(F.col("grp") == g, F.col("value"))), F.lit(0.0))
    means = rows.groupBy("name").agg(mean("a").alias("mean_persistent"), mean("b").alias("mean_episodic"))
    u = tracking.rank_sums(rows, ["name"], "grp", "value")
    tested = u.withColumn("p", tracking.u_p("u", "n_a", "n_b", "ties")).withColumn("one", F.lit(1))
    adjusted = tracking.adjusted(tested.where("p is not null"), ["one"], "p", "name").select("name", "p_adj")
    out = means.join(tested, "name").join(adjusted, "name", "left")
    order = Window.orderBy(F.desc(F.abs("delta")), "name")  # one row per descriptor
    return out.select("name", F.round("mean_persistent", 4).alias("mean_persistent"), F.round("mean_episodic", 4).alias("mean_episodic"), F.round("delta", 4).alias("delta"), "u", F.round("p", 6).alias("p"), F.round("p_adj", 6).alias("p_adj"), F.row_number().over(order).alias("rank"))


def matched_candidates(matrix: DataFrame, spots: DataFrame, quantile: float = 0.02, min_ratio: float = 3.0, max_overlap: float = 0.05, sample: int = 1500) -> DataFrame:
    """Pairs with nearly the same shape and very different incidents: a (more incidents), b, ratio, distance, overlap.

    All pairs of hotspots are looked at. How near is near is the quantile of the distances among ``sample`` hotspots, chosen by hash: an estimate from a bounded sample."""
    rows = matrix.select("id", "structural").join(spots.select("id", "crimes", "nodes"), "id")
    distance = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    side = lambda df, x: df.select(*[F.col(c).alias(f"{x}_{c}") for c in df.columns])
    few = rows.select("id", "structural").orderBy(F.xxhash64("id"), "id").limit(sample)
    at = side(few, "a").join(side(few, "b"), F.col("a_id") < F.col("b_id")).agg(F.percentile(distance("a_structural", "b_structural"), F.lit(quantile)).alias("near")).first()[0]
    if at is None:
        at = -1.0
    pairs = side(rows, "a").join(side(rows, "b"), (F.col("a_crimes") >= F.lit(min_ratio) * F.col("b_crimes")) & (F.col("b_crimes") > 0) & (F.col("a_id") != F.col("b_id")))
    pairs = pairs.withColumn("distance", distance("a_structural", "b_structural")).where(F.col("distance") <= at)
    shared = F.size(F.array_intersect("a_nodes", "b_nodes"))
    pairs = pairs.withColumn("overlap", shared / (F.size("a_nodes") + F.size("b_nodes") - shared)).where(F.col("overlap") <= max_overlap)
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(F.col("a_crimes") / F.col("b_crimes"), 2).alias("ratio"), F.round("distance", 4).alias("distance"), F.round("overlap", 4).alias("overlap"))


# synthetic truth


def clustered_incidents(edges: DataFrame, realisations: int, parents: int = 15, offspring: int = 200, background: int = 100, seed: int = 20200) -> tuple[DataFrame, DataFrame]:
    """Counts (mes, node_id, c) of each realisation and its true nodes (mes, node_id): parent edges without repeats, each child on one end of a parent, and incidents anywhere. All draws are hashes of
    (seed, realisation, number)."""
    spark = edges.sparkSession
    turns = spark.range(realisations).select(F.format_string("synth_%02d", F.col("id")).alias("mes"))
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    if pairs.count() < parents:
        raise ValueError(f"{parents} parent edges of a network with fewer")
    order = Window.partitionBy("mes").orderBy(F.xxhash64(F.lit(seed), "mes", "u", "v"), "u", "v")  # a crop of some hundreds of nodes
    sown = storage.saved(turns.crossJoin(pairs).withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < parents), "parents")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node_id")).distinct().withColumn("i", F.row_number().over(Window.orderBy("node_id")) - 1)
    size = nodes.count()
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed + salt), "mes", "j"), F.lit(n)).cast("int")
    children = turns.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(offspring)))).withColumns({"k": draw(1, parents), "end": draw(2, 2)})
    placed = children.join(sown, ["mes", "k"]).select("mes", F.when(F.col("end") == 0, F.col("u")).otherwise(F.col("v")).alias("node_id"))
    if background:
        noise = turns.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(background)))).withColumn("i", draw(3, size)).join(nodes, "i").select("mes", "node_id")
        placed = placed.unionByName(noise)
    return placed.groupBy("mes", "node_id").agg(F.count("*").alias("c")), sown.select("mes", F.explode(F.array("u", "v")).alias("node_id")).distinct()


def scored(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """mes, method, ppv, sensitivity, f1, n_detected, n_true, n_hit of the detected nodes (mes, method, node_id) against the true ones; 0 where there is nothing to divide by."""
    found = detected.select("mes", "method", "node_id").distinct()
    hits = found.join(truth, ["mes", "node_id"]).groupBy("mes", "method").agg(F.count("*").alias("n_hit"))
    real = truth.groupBy("mes").agg(F.count("*").alias("n_true"))
    out = found.groupBy("mes", "method").agg(F.count("*").alias("n_detected")).join(real, "mes").join(hits, ["mes", "method"], "left").fillna(0, ["n_hit"])
    out = out.withColumns({"ppv": F.coalesce(F.try_divide("n_hit", "n_detected"), F.lit(0.0)), "sensitivity": F.coalesce(F.try_divide("n_hit", "n_true"), F.lit(0.0))})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("ppv") * F.col("sensitivity"), F.col("ppv") + F.col("sensitivity")), F.lit(0.0)))


def benchmark_stats(scores: DataFrame) -> DataFrame:
    """method, measure, mean, sd, cv over the realisations."""
    long = scores.unpivot(["mes", "method"], ["ppv", "sensitivity", "f1"], "measure", "v")
    mean, sd = F.avg("v"), F.stddev_samp("v")
    return long.groupBy("method", "measure").agg(F.round(mean, 4).alias("mean"), F.round(F.coalesce(sd, F.lit(0.0)), 4).alias("sd"), F.round(F.try_divide(sd, mean), 4).alias("cv"))


def benchmark_tests(scores: DataFrame, base: str = "topo") -> DataFrame:
    """Two-sided tests of U between the realisations of ``base`` and of each other method: method, measure, u, p."""
    long = scores.unpivot(["mes", "method"], ["ppv", "sensitivity", "f1"], "measure", "value")
    others = long.where(F.col("method") != base).select("method", "measure", "value", F.lit("b").alias("grp"))
    names = others.select(F.col("method").alias("other")).distinct()
    own = long.where(F.col("method") == base).crossJoin(F.broadcast(names)).select(F.col("other").alias("method"), "measure", "value", F.lit("a").alias("grp"))
    u = tracking.rank_sums(own.unionByName(others), ["method", "measure"], "grp", "value")
    return u.select("method", "measure", "u", F.round(tracking.u_p("u", "n_a", "n_b", "ties"), 6).alias("p"))


# picking and comparing


#: Shapes to show, each with what it must be and by what it is best, over the scaled descriptors, shares of road classes and sizes.
ARCHETYPES = (
    ("dyad", "n_nodes = 2", "-n_edges"),
    ("short chain", "n_nodes between 3 and 4 and n_edges = n_nodes - 1 and elongation < 0.25", "elongation"),
    ("corridor", "n_nodes >= 9 and n_edges <= n_nodes + 1 and elongation < 0.3", "elongation, -n_nodes"),
    ("star", "degree_1 >= 0.45 and mean_degree < 0.45 and n_nodes between 4 and 10", "-degree_1"),
    ("ring", "degree_2 >= 0.75 and abs(n_edges - n_nodes) <= 1 and n_nodes >= 6", "-degree_2"),
    ("tree", "n_edges = n_nodes - 1 and degree_3 + degree_4 >= 0.18 and n_nodes >= 7", "-(degree_3 + degree_4)"),
    ("compact grid", "n_nodes between 8 and 28 and density >= 0.1 and mean_degree >= 0.45 and elongation >= 0.55", "-density, -elongation"),
    ("large grid", "n_nodes >= 45 and mean_degree >= 0.45", "-n_nodes, -mean_degree"),
    ("comb", "degree_1 >= 0.3 and degree_3 >= 0.18 and n_nodes >= 8", "-(degree_1 * degree_3)"),
    ("mixed roads", "dominance <= 0.62 and major > 0 and n_nodes >= 8", "dominance"),
)


def archetypes(spots: DataFrame, matrix: DataFrame, major: int = 2) -> DataFrame:
    """archetype and id: for each shape the best hotspot that no earlier one took, of those that five others share a node with, else one other, else none; a taken one rather than none of the shape, and any free one
    where there is none. ``major`` is how many of the first road classes count as major roads.

    At most as many hotspots are taken as there are shapes, so the best few of each shape and tier are all that comes to the driver."""
    own = members(spots)
    again = own.join(own.select(F.col("id").alias("other"), "node_id"), "node_id").where("id <> other").groupBy("id").agg(F.count_distinct("other").alias("same"))  # a node is in one hotspot of a month at most
    rows = matrix.select("id", *[F.element_at("structural", k + 1).alias(c) for k, c in enumerate(STRUCTURE)], F.element_at("hierarchy", -1).alias("dominance"), F.aggregate(F.slice("hierarchy", 1, major), F.lit(0.0), lambda s, v: s + v).alias("major"))
    rows = rows.join(spots.select("id", "n_nodes", F.size("edges").alias("n_edges")), "id").join(again, "id", "left").fillna(0, ["same"])
    tier = F.when(F.col("same") >= 5, 0).when(F.col("same") >= 1, 1).otherwise(2)
    rows = storage.saved(rows.withColumn("tier", tier), "shapes")
    few = len(ARCHETYPES)
    first = [r["id"] for r in rows.orderBy("id").select("id").limit(few).collect()]
    taken: list[tuple[str, str]] = []
    used: set[str] = set()
    for name, what, best in ARCHETYPES:
        by = [F.expr(x) for x in best.split(", ")]
        fit = rows.where(what)
        ranked = fit.withColumn("n", F.row_number().over(Window.partitionBy("tier").orderBy(*by, "id"))).where(F.col("n") <= few).orderBy("tier", "n").select("id").collect()
        any_ = [r["id"] for r in fit.orderBy(*by, "id").select("id").limit(1).collect()]
        free = [r["id"] for r in ranked if r["id"] not in used] or any_ or [x for x in first if x not in used] or first[:1]
        if free:
            used.add(free[0])
            taken.append((name, free[0]))
    return spots.sparkSession.createDataFrame(taken, "archetype string, id string")


def pair(spots: DataFrame, profiles: DataFrame, categories: list[str], months: list[str], a: str, b: str) -> DataFrame:
    """What two hotspots have: part, name, a, b, delta and side (both, only a, only b), for incidents, kinds of incidents, each month's incidents, places by category and the entropy of places."""
    both = spots.where(F.col("id").isin(a, b)).withColumn("hot", F.when(F.col("id") == a, "a").otherwise("b"))
    around = profiles.where(F.col("id").isin(a, b)).withColumn("hot", F.when(F.col("id") == a, "a").otherwise("b"))
    listed = lambda names: F.array(*[F.lit(x) for x in names])
    zipped = lambda df, part, names, column: df.select("hot", F.lit(part).alias("part"), F.explode(F.arrays_zip(listed(names).alias("name"), F.col(column).alias("v"))).alias("z")).select("hot", "part", "z.name", F.col("z.v").cast("double").alias("v"))
    long = both.select("hot", F.lit("incidents").alias("part"), F.lit("all").alias("name"), F.col("crimes").cast("double").alias("v"))
    long = long.unionByName(both.select("hot", F.lit("kind").alias("part"), F.explode("by_category").alias("name", "v")).withColumn("v", F.col("v").cast("double")))
    long = long.unionByName(zipped(both, "month", months, "series")).unionByName(zipped(around, "places", categories, "counts"))
    long = long.unionByName(around.select("hot", F.lit("entropy").alias("part"), F.lit("places").alias("name"), F.col("entropy").alias("v")))
    side = lambda h: F.coalesce(F.sum(F.when(F.col("hot") == h, F.col("v"))), F.lit(0.0))
    out = long.groupBy("part", "name").agg(side("a").alias("a"), side("b").alias("b"))
    return out.withColumn("delta", F.col("a") - F.col("b")).withColumn("side", F.when((F.col("a") > 0) & (F.col("b") == 0), "only a").when((F.col("b") > 0) & (F.col("a") == 0), "only b").otherwise("both"))
