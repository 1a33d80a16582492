"""Properties of the operators that SQL cannot express."""

import itertools
import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citadine import storage
from citadine.functions import parsing
from citadine.functions.statistics import poisson_llr
from citadine.operators import chain, clustering, describing, field, regions, selecting, tracking
from citadine.operators import network as networks
from citadine.plans import catalog
from citadine.plans.regions import null_maxima
from citadine.sources.pois import Taxonomy


def lattice(n=7):
    out = {}
    for i in range(n):
        for j in range(n):
            out[i * n + j] = [a * n + b for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < n and 0 <= b < n]
    return out


def connected(nodes, neighbours):
    nodes, seen = set(nodes), set()
    stack = [next(iter(nodes))]
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            stack += [u for u in neighbours[v] if u in nodes]
    return seen == nodes


def network(grid):
    return regions.Network.of(np.array([a for a in grid for _ in grid[a]]), np.array([b for a in grid for b in grid[a]]))


def regions_of(height, grid, tau, floor=0.0):
    """The region (its peak) of every node, and each peak's persistence."""
    top = max(height.values())
    ids = np.array(sorted(v for v in height if height[v] >= floor * top))
    found = regions.partitioned(ids, np.array([height[v] for v in ids]), *network(grid).within(ids), [tau])[0]
    return dict(zip(found["node_id"], found["peak"])), dict(zip(found["peak"], found["persistence"]))


def rise(peak, height, grid):
    """What a peak rises above the highest pass to a higher one, by trying all levels; its height if there is no higher one."""
    higher = lambda v: (height[v], -v) > (height[peak], -peak)
    for level in sorted(set(height.values()), reverse=True):
        seen, stack = set(), [peak]
        while stack:
            v = stack.pop()
            if v not in seen and height[v] >= level:
                seen.add(v)
                stack += [u for u in grid[v] if u in height]
        if any(higher(v) for v in seen):
            return height[peak] - level
    return math.inf


@pytest.mark.parametrize("seed", range(8))
def test_regions_are_connected_and_their_peaks_are_those_that_rise_enough(seed):
    rng, grid = random.Random(seed), lattice()
    height = {v: round(rng.random(), 1 if seed % 2 else 3) for v in grid}
    sizes = []
    for tau in (0.001, 0.2, 0.6, 2.0):
        home, _ = regions_of(height, grid, tau)
        assert set(home) == set(grid)
        groups = {p: [v for v in home if home[v] == p] for p in set(home.values())}
        assert all(connected(g, grid) and max(g, key=lambda v: (height[v], -v)) == p for p, g in groups.items())
        assert set(groups) == {v for v in grid if rise(v, height, grid) >= tau}
        sizes.append(len(groups))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 1


def test_a_higher_floor_is_the_first_places_of_the_same_forest():
    rng, grid = random.Random(9), lattice()
    height = {v: round(rng.random(), 3) for v in grid}
    ids = np.array(sorted(height))
    forest = regions.Forest(ids, np.array([height[v] for v in ids]), *network(grid).within(ids))
    for floor in (0.2, 0.5, 0.8):
        size = sum(h >= floor * max(height.values()) for h in height.values())
        for tau in (0.0, 0.1, 0.3):
            home, persistence = forest.regions(tau, size)
            want, rises = regions_of(height, grid, tau, floor)
            assert {int(v): int(forest.ids[p]) for v, p in zip(forest.ids, home)} == want
            assert all(persistence[p] == pytest.approx(rises[forest.ids[p]]) for p in set(home.tolist()))


def test_peaked_field_keeps_its_peaks():
    grid = lattice()
    height = {v: 0.05 for v in grid}
    height[8], height[40], height[10] = 1.0, 0.8, 0.3
    home, persistence = regions_of(height, grid, 0.5)
    assert set(home.values()) == {8, 40} and persistence[40] == pytest.approx(0.75)


def test_growth_reaches_its_budget_without_overlap():
    grid, count = lattice(), {8: 20, 9: 12, 40: 15, 39: 9}
    taken: set[int] = set()
    near = network(grid).near
    a = regions.grow(8, 3, near, taken, regions.by_count(count))
    b = regions.grow(40, 4, near, taken, regions.by_hops(count))
    assert len(a) == 3 and a[:2] == [8, 9] and b == [40, 33, 39, 41] and not set(a) & set(b) and taken == {*a, *b}
    assert connected(a, grid) and connected(b, grid)


def test_regions_by_rows_equal_those_by_broadcast(spark, monkeypatch):
    grid, rng = lattice(), random.Random(4)
    arcs = spark.createDataFrame([(a, b) for a in grid for b in grid[a]], "src long, dst long")
    field = spark.createDataFrame([(m, v, rng.random()) for m in ("a", "b") for v in grid], "mes string, node_id long, f double")
    wide = {tuple(r) for r in regions.segment(field, arcs, ["mes"], 0.1, 0.3).collect()}
    monkeypatch.setattr(regions, "MOST_ARCS", 10)
    assert {tuple(r) for r in regions.segment(field, arcs, ["mes"], 0.1, 0.3).collect()} == wide
    with pytest.raises(ValueError):
        regions.grown(field.withColumn("c", F.lit(1)), arcs, ["mes"], 2, 3)


def test_fields_broadcast_neither_counts_nor_kernel(spark):
    """Small files can hold many rows, so that their size must not choose a broadcast."""
    counts = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 2, 2)], "mes string, node_id long, c long")
    near = spark.createDataFrame([(a, b, 100.0 * abs(a - b)) for a in range(5) for b in range(5)], "src long, dst long, d double")
    arcs = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if abs(a - b) == 1], "src long, dst long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    f = field.density_field(counts, near, 60.0, ["mes"])
    found = regions.hotspots(regions.segment(f, arcs, ["mes"], 0.1, 0.1), counts, ["mes"])
    grid = selecting.swept(counts, near, arcs, 5, [40.0, 60.0], [0.1], [0.1], [2])
    assert all("SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df) for df in (f, found, grid))
    for sigma in (40.0, 60.0):  # each sigma's own field, of nodes within its reach only
        one = field.density_field(counts, near.where(F.col("d") <= 3 * sigma), sigma, ["mes"]).join(counts, ["mes", "node_id"], "left").fillna(0, ["c"])
        parts = regions.swept(one, arcs, ["mes"], [0.1], [0.1], [2]).agg(F.sum("captured"), F.sum("nodes"), F.sum("hotspots")).first()
        assert tuple(grid.where(F.col("sigma") == sigma).select("captured", "nodes", "hotspots").first()) == tuple(parts)


@pytest.mark.parametrize("name", ["poi_in_zone", "poi_entropy", "location_quotient", "payload_join", "poi_contrast"])
def test_exploded_points_are_not_broadcast(spark, sf, name):
    seen = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    for i in (i for i, line in enumerate(seen) if "Generate explode" in line):
        above, at = [], depth(seen[i])
        for line in reversed(seen[:i]):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
        first = next(x for x in above if "Join" in x)
        assert "SortMergeJoin" in first and not any("Broadcast" in x for x in above[: above.index(first)])


def test_hashes_are_those_of_spark(spark):
    seeds = spark.createDataFrame([("1994-01", 1), ("", 99)], "mes string, replicate int").withColumn("h", F.xxhash64(F.lit(7), "mes", "replicate"))
    for r in seeds.withColumn("k", F.sequence(F.lit(1), F.lit(50))).withColumn("all", F.transform("k", lambda k: F.xxhash64(F.lit(7), "mes", "replicate", k))).collect():
        assert regions.hashed(np.int64(r["h"]), 50).tolist() == r["all"]


@pytest.mark.parametrize("gaps", [False, True])
def test_null_in_arrays_is_that_of_rows(spark, monkeypatch, gaps):
    """The replicates of a network with a node without arcs and, with ``gaps``, an index that names no node, are those that rows per node give; none of these rows is made."""
    grid = lattice(9)
    arcs = spark.createDataFrame([(1000 + a, 1000 + b, 80.0 + (a + b) % 40) for a in grid for b in grid[a]], "src long, dst long, length double")
    nodes = spark.createDataFrame([(1000 + v, v) for v in range(82) if not (gaps and v % 7 == 3)], "node_id long, idx long")
    counts = spark.createDataFrame([(m, 1000 + v, 1 + v % 3) for m, k in (("a", 2), ("b", 5)) for v in range(0, 81, k)], "mes string, node_id long, c long")
    near, by, size = field.kernel(arcs, 360.0, 80.0).cache(), ["mes", "replicate"], nodes.count()
    drawn = regions.null_counts(counts, nodes, ["mes"], 6, 7).cache()
    found = regions.hotspots(regions.segment(field.density_field(drawn, near, 120.0, by), arcs, by, 0.15, 0.2), drawn, by)
    total = drawn.groupBy(*by).agg(F.sum("c").alias("n_total"))
    llr = poisson_llr(F.col("score") * 1.0, F.col("n_nodes") * 1.0, F.col("n_total") * 1.0, F.lit(float(size)))
    rows = found.join(total, by).groupBy(*by).agg(F.round(F.max(llr), 6).alias("value"), F.max("n_total").alias("n_total")).orderBy(*by).collect()
    monkeypatch.setattr(regions, "null_counts", lambda *a: pytest.fail("drawn incidents became rows"))
    own = regions.null_highest(counts, nodes, arcs, near, ["mes"], 6, 7, 120.0, 0.15, 0.2)
    assert len(rows) == 12 and [tuple(r) for r in own.withColumn("value", F.round("value", 6)).orderBy(*by).collect()] == [tuple(r) for r in rows]
    monkeypatch.setattr(regions, "MOST_ARCS", 10)
    assert regions.null_highest(counts, nodes, arcs, near, ["mes"], 6, 7, 120.0, 0.15, 0.2) is None


def test_null_of_a_network_too_large_is_rows(spark, sf, monkeypatch):
    first = sorted(map(tuple, null_maxima(spark, sf, 3).collect()))
    monkeypatch.setattr(regions, "null_highest", lambda *a: None)
    assert sorted(map(tuple, null_maxima(spark, sf, 3).collect())) == first


def joins(df):
    seen = df._jdf.queryExecution().executedPlan().toString()
    return seen.count("SortMergeJoin"), seen.count("BroadcastHashJoin")


def test_members_and_edges_are_not_broadcast(spark):
    """Tables of hotspots are small files of many nodes, and a network's files are small for its edges."""
    spots = storage.saved(spark.createDataFrame([("m_h01", "m", [1, 2, 3], 0), ("n_h01", "n", [2, 3], 1)], "id string, mes string, nodes array<long>, t int"), "spots")
    edges = storage.saved(spark.createDataFrame([(1, 2), (2, 3)], "u long, v long"), "edges")
    counts = storage.saved(spark.createDataFrame([("m", 1, 3), ("n", 2, 1)], "mes string, node_id long, c long"), "counts")
    own = chain.members(spots)
    inner = networks.induced_edges(edges, own.select("id", "node_id"), ["id"])
    assert joins(inner) == (2, 0) and sorted(map(tuple, inner.select("id", "u", "v").collect())) == [("m_h01", 1, 2), ("m_h01", 2, 3), ("n_h01", 2, 3)]
    assert joins(own.join(counts, ["mes", "node_id"])) == (1, 0)
    pairs = tracking.overlaps(spots.select("t", "id", F.explode("nodes").alias("node_id")), "t", "id", "node_id", 3, 0.2)
    assert joins(pairs)[1] == 0 and pairs.select("a", "b", "iou").first()[:2] == ("n_h01", "m_h01")
    placed = storage.saved(own.select("id", "node_id", (F.col("node_id") * 1.0).alias("x"), F.lit(0.0).alias("y")), "placed")
    assert joins(describing.structural(placed, inner.select("id", "u", "v"), "id"))[0] >= 3


def test_points_in_hulls_are_not_broadcast(spark):
    corners = storage.saved(spark.createDataFrame([("a", [(0.0, 0.0), (100.0, 0.0), (0.0, 100.0)])], "id string, corners array<struct<x:double,y:double>>"), "corners")
    points = storage.saved(spark.createDataFrame([(1, 10.0, 10.0), (2, 900.0, 10.0), (3, -20.0, 10.0)], "k int, x double, y double"), "points")
    found = chain.inside(corners, points, 50.0)
    assert joins(found) == (1, 0) and sorted(r["k"] for r in found.collect()) == [1, 3]


def test_both_growths_share_one_network(spark, monkeypatch):
    made, spread = [], regions.spread
    monkeypatch.setattr(regions, "spread", lambda arcs: made.append(1) or spread(arcs))
    arcs = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    counts = spark.createDataFrame([("m", 1, 3), ("m", 2, 1)], "mes string, node_id long, c long")
    spots = spark.createDataFrame([("m", 3, 1)], "mes string, crimes long, n_nodes int")
    assert chain.families(spots, counts, arcs).count() == 3 and made == [1]


def test_networks_are_packed_by_tasks(spark, monkeypatch):
    """Nothing but compressed slices comes to the driver, and what tasks unpack is the network."""
    rng = random.Random(5)
    pairs = [(rng.choice((-3, 0, 7, 2**40)) + rng.randrange(50), rng.randrange(60)) for _ in range(400)]
    arcs = spark.createDataFrame([(a, b, float(i)) for i, (a, b) in enumerate(pairs)], "src long, dst long, length double")
    monkeypatch.setattr(type(arcs), "toPandas", lambda self: pytest.fail("the network came to the driver"))
    plain = regions.Network.of(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    own = regions.spread(arcs).value
    assert all(np.array_equal(getattr(own, x), getattr(plain, x)) for x in ("ids", "start", "to"))
    shared = pickle.loads(pickle.dumps(regions.packed(arcs)))
    assert shared.lengths.tolist() == [k for _, _, k in sorted((a, b, float(i)) for i, (a, b) in enumerate(pairs))] and len(shared.slices) <= 16
    assert len(regions.packed(arcs.where("src > dst and src < dst")).network.ids) == 0


def test_clusters_of_two_clouds_and_noise():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[50.0, 50.0]]])
    found = clustering.clusters(x, 5)
    assert len(set(found[:30])) == 1 and len(set(found[30:60])) == 1 and found[0] != found[30] and found[60] == -1
    line = np.arange(3000.0)[:, None] ** 1.5  # a chain that would be thousands of calls deep
    assert len(clustering.clusters(line, 5)) == 3000


def splits(a, b):
    """Two-sided p of U by trying all ways to part the values."""
    both, n, u = [*a, *b], len(a), lambda x, y: sum(p > q for p in x for q in y)
    most = max(u(a, b), u(b, a))
    tries = [u([both[i] for i in own], [both[i] for i in range(len(both)) if i not in own]) for own in itertools.combinations(range(len(both)), n)]
    return min(1.0, 2 * sum(t >= most for t in tries) / len(tries))


def test_p_of_small_samples_is_that_of_all_splits(spark):
    rng, rows = random.Random(6), []
    samples = {f"t{k}": ([rng.random() + k / 9 for _ in range(rng.randint(1, 5))], [rng.random() for _ in range(rng.randint(1, 6))]) for k in range(12)}
    for t, (a, b) in samples.items():
        rows += [(t, "a", x) for x in a] + [(t, "b", x) for x in b]
    u = tracking.rank_sums(spark.createDataFrame(rows, "t string, g string, v double"), ["t"], "g", "v")
    got = {r["t"]: r["p"] for r in u.select("t", tracking.u_p("u", "n_a", "n_b", "ties").alias("p")).collect()}
    assert all(got[t] == pytest.approx(splits(*ab)) for t, ab in samples.items())
    assert tracking.exact_u_p(0, 3, 3) == pytest.approx(0.1)
    assert tracking.normal_u_p(50 * 50 / 2, 50, 50, 0) == 1.0 and tracking.normal_u_p(1600, 50, 50, 0) == pytest.approx(0.0161, abs=2e-4)


def test_headers():
    required = {"lat": ["latitude", "lat"], "lon": ["longitude", "log"]}
    assert parsing.resolve_columns(["LATITUDE ", "log"], required) == {"lat": "LATITUDE ", "lon": "log"}
    assert parsing.header_key("Fecha__de-Récord") == "fecha de record"
    with pytest.raises(parsing.MissingColumn):
        parsing.resolve_columns(["a"], required)
    with pytest.raises(parsing.MissingColumn):
        parsing.resolve_columns(["lat", "lon"], required, pinned={"lat": "y"})


def test_taxonomy_checks():
    with pytest.raises(ValueError):
        Taxonomy(["a"], {("shop", "x"): "b"})
    with pytest.raises(ValueError):
        Taxonomy(["a"], {("shop", "x"): "a"}, {("shop", "x")})


def test_hotspots_are_disjoint_and_linked(spark, sf):
    found = catalog.queries()["extract_hotspots"](spark, sf).collect()
    by_month = {}
    for h in found:
        nodes = by_month.setdefault(h["mes"], set())
        assert not nodes & set(h["nodes"]) and h["seed_node"] in h["nodes"] and h["score"] > 0
        nodes |= set(h["nodes"])


def test_null_keeps_the_number_of_incidents(spark, sf):
    for name in ("montecarlo_null", "montecarlo_null_permutation"):
        rows = catalog.queries()[name](spark, sf).collect()
        months = {}
        for r in rows:
            assert r["value"] >= 0 and math.isfinite(r["value"])
            months.setdefault(r["mes"], set()).add(r["n_total"])
        assert months and all(len(v) == 1 for v in months.values())


def test_vectors_ignore_node_ids(spark, sf):
    rows = {r["zone"]: r["vector"] for r in catalog.queries()["netlsd"](spark, sf).collect()}
    assert len({tuple(v) for z, v in rows.items()}) < len(rows)  # equal zones have equal signatures


def test_matched_pairs_go_on_after_a_hot_member(spark):
    """A member with more and better pairs than all others still leaves room for as many pairs as asked for."""
    hot = [(0, b, 9.0 - b / 10000, 0.1) for b in range(1, 2501)]
    rest = [(a, a + 1, 2.0 - a / 10000, 0.1) for a in range(1, 200, 2)] + [(a, a + 2, 1.5, a / 1000) for a in range(1, 60)]
    rows, used, want = hot + rest, Counter(), []
    for a, b, ratio, distance in sorted(rows, key=lambda r: (-r[2], r[3], r[0], r[1])):
        if len(want) < 25 and used[a] < 2 and used[b] < 2:
            used.update((a, b))
            want.append((a, b, ratio, distance))
    got = tracking.capped_pairs(spark.createDataFrame(rows, "a long, b long, ratio double, distance double").repartition(3))
    assert [tuple(r) for r in got.collect()] == want and len(want) == 25
