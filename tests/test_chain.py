"""The chain from a written region table on, against plain Python; and the commands on a small city of files."""

import itertools
import json
import math
import random
import types
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citadine import cli, storage
from citadine.functions.spatial import hull
from citadine.operators import chain, embedding, regions, selecting, tracking
from citadine.sources import artifacts, config

SIDE = 6


def place(v):
    return (v % SIDE) * 100.0, (v // SIDE) * 100.0


EDGES = [(v, v + 1) for v in range(SIDE * SIDE) if v % SIDE < SIDE - 1] + [(v, v + SIDE) for v in range(SIDE * (SIDE - 1))]
#: Nodes by region: a line, an L, a square, and one of another month on the line.
SPOTS = {"2020-01_h01": [0, 1, 2, 3, 4], "2020-01_h02": [12, 18, 24, 25, 26], "2020-02_h01": [1, 2, 3, 4], "2020-02_h02": [27, 28, 33, 34]}


@pytest.fixture(scope="module")
def city(spark):
    rng = random.Random(1)
    nodes = spark.createDataFrame([(v, *place(v)) for v in range(SIDE * SIDE)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(u, v, 100.0, "avenue" if v - u > 1 else "street") for u, v in EDGES], "u long, v long, length double, road_class string")
    incidents = [(f"2020-0{1 + k % 3}", rng.choice(sum(SPOTS.values(), []) + list(range(36))), rng.choice("ab")) for k in range(400)]
    kinds = Counter(incidents)
    counts = Counter((m, v) for m, v, _ in incidents)
    return types.SimpleNamespace(
        nodes=nodes,
        edges=edges,
        arcs=spark.createDataFrame([(a, b, 100.0) for u, v in EDGES for a, b in ((u, v), (v, u))], "src long, dst long, length double"),
        counts=spark.createDataFrame([(*k, n) for k, n in counts.items()], "mes string, node_id long, c long"),
        kinds=spark.createDataFrame([(*k, n) for k, n in kinds.items()], "mes string, node_id long, tipo string, c long"),
        count=counts,
        kind=kinds,
    )


@pytest.fixture(scope="module")
def found(spark, city):
    """Regions as segment gives them; a region without incidents is left out later."""
    rows = [(k[:7], own[0], v, 0.5, 1.0 - own[0] / 100, 1.0 - v / 100) for k, own in SPOTS.items() for v in own]
    return spark.createDataFrame(rows, "mes string, peak long, node_id long, persistence double, peak_f double, f double")


@pytest.fixture(scope="module")
def spots(found, city):
    return storage.saved(chain.records(found, city.counts, city.kinds, city.edges, 36, "fixed", k=20), "spots")


def test_records(spots, city):
    totals = Counter()
    for (m, _), n in city.count.items():
        totals[m] += n
    got = {tuple(r["nodes"]): r.asDict() for r in spots.collect()}
    assert set(got) == {tuple(v) for v in SPOTS.values()}
    for name, own in SPOTS.items():
        r, mes = got[tuple(own)], name[:7]
        score = sum(city.count[mes, v] for v in own)
        assert r["crimes"] == score and r["mes"] == mes and r["n_nodes"] == len(own) and r["density"] == round(score / len(own), 4) and r["p_value"] is None
        assert r["by_category"] == {t: n for t in "ab" if (n := sum(city.kind[mes, v, t] for v in own))}
        assert {tuple(e) for e in r["edges"]} == {(u, v) for u, v in EDGES if u in own and v in own}
        assert r["series"] == [sum(city.count[m, v] for v in own) for m in ("2020-01", "2020-02", "2020-03")]
        assert r["seed_node"] == max(own, key=lambda v: (city.count[mes, v], -v)) and r["peak_node"] == own[0]
        expected = totals[mes] * len(own) / 36
        llr = score * math.log(score / expected) + (totals[mes] - score) * math.log((totals[mes] - score) / (totals[mes] - expected)) if score > expected else 0.0
        assert r["llr"] == pytest.approx(llr, abs=1e-4)
    for mes in ("2020-01", "2020-02"):
        ranked = sorted((r for r in got.values() if r["mes"] == mes), key=lambda r: r["id"])
        assert [r["id"] for r in ranked] == [f"{mes}_h{k:02d}" for k in range(1, len(ranked) + 1)] and [r["crimes"] for r in ranked] == sorted((r["crimes"] for r in ranked), reverse=True)


def test_selection_by_replicates_is_clamped(spark):
    scored = spark.createDataFrame([("m", k, 10 - k, x) for k, x in enumerate([1.0, 9.0, 3.0, 8.0, 7.0])], "mes string, peak long, score long, llr double")
    null = spark.createDataFrame([("m", 4.0 if k else 6.0) for k in range(19)], "mes string, value double")
    pick = lambda **o: [r["peak"] for r in selecting.resolve("montecarlo", scored, ["mes"], [F.desc("score")], null_max=null, **o).orderBy("peak").collect()]
    assert pick(alpha=0.06) == [1, 3, 4] and pick(alpha=0.06, max_k=2) == [1, 3] and pick(alpha=0.01, min_k=2) == [0, 1] and pick(alpha=0.01) == []


def test_evaluation_against_grown_regions(spots, city):
    months = chain.monthly(storage.saved(chain.families(spots, city.counts, city.arcs), "families"), city.counts)
    got = {(r["mes"], r["method"]): r.asDict() for r in months.collect()}
    assert set(got) == {(m, k) for m in ("2020-01", "2020-02") for k in ("topo", "greedy", "bfs")}
    for mes in ("2020-01", "2020-02"):
        own = [v for k, v in SPOTS.items() if k.startswith(mes)]
        budget = round(sum(map(len, own)) / len(own))
        crimes = sum(n for (m, _), n in city.count.items() if m == mes)
        topo, greedy = got[mes, "topo"], got[mes, "greedy"]
        assert topo["captured"] == sum(city.count[mes, v] for x in own for v in x) and topo["coverage"] == round(topo["captured"] / crimes, 5)
        assert greedy["budget"] == budget and greedy["hotspots"] == len(own) and greedy["nodes"] <= budget * len(own) and greedy["gain"] == topo["captured"] - greedy["captured"]
    total = {r["method"]: r.asDict() for r in chain.compared(months).collect()}
    captured, nodes = (sum(got[m, "topo"][c] for m in ("2020-01", "2020-02")) for c in ("captured", "nodes"))
    assert total["topo"]["captured"] == captured and total["topo"]["density"] == round(captured / nodes, 4) and total["topo"]["gain_absolute"] == 0
    assert total["bfs"]["gain_absolute"] == captured - total["bfs"]["captured"]


def test_no_count_reaches_what_similarity_is_of(spark, spots, city):
    blocks = lambda s: sorted(tuple(map(str, r)) for r in chain.blocks(*chain.shapes(s, city.nodes, city.edges), ["avenue", "street"], "netlsd", dimensions=4).collect())
    assert blocks(spots) == blocks(spots.withColumns({"crimes": F.col("crimes") * 7 + 1, "density": F.lit(0.5), "series": F.array(F.lit(1).cast("long")), "by_category": F.create_map(F.lit("z"), F.lit(1).cast("long"))}))


def test_similar_hotspots_elsewhere_share_no_node(spots, city):
    rows = chain.blocks(*chain.shapes(spots, city.nodes, city.edges), ["avenue", "street"], "netlsd", dimensions=4)
    vectors = storage.saved(chain.fused(rows, {"structural": 1.0, "embedding": 1.0, "hierarchy": 0.5}), "vectors")
    v = {r["id"]: np.array(r["vector"]) for r in vectors.collect()}
    nodes = {r["id"]: set(r["nodes"]) for r in spots.collect()}
    cosine = lambda a, b: float(v[a] @ v[b] / (np.linalg.norm(v[a]) * np.linalg.norm(v[b]) or 1))
    found = chain.similar(vectors, spots, 2).collect()
    for a in v:
        for distinct in (False, True):
            own = [r for r in found if r["a"] == a and r["distinct"] == distinct]
            allowed = [b for b in v if b != a and not (distinct and nodes[a] & nodes[b])]
            want = sorted((round(cosine(a, b), 6) for b in allowed), reverse=True)[:2]
            assert sorted((r["similarity"] for r in own), reverse=True) == pytest.approx(want, abs=2e-5) and {r["b"] for r in own} <= set(allowed)
            assert all(r["jaccard"] == round(len(nodes[a] & nodes[r["b"]]) / len(nodes[a] | nodes[r["b"]]), 4) for r in own)
    length = sum(np.std([x[j] for x in v.values()]) > 0 for j in range(len(v[a])))
    assert 0 < length <= 12 + 4 + 3


def away(p, ring):
    sides = zip(ring, ring[1:] + ring[:1])
    inside, least = len(ring) > 2, math.inf
    for (ax, ay), (bx, by) in sides:
        t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / (((bx - ax) ** 2 + (by - ay) ** 2) or 1.0)))
        least = min(least, math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay)))
        inside &= (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0
    return 0.0 if inside else least


def test_hulls_and_what_lies_in_them(spark):
    rng = random.Random(3)
    sets = {f"z{k}": [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(rng.randint(1, 12))] for k in range(12)} | {"line": [(k * 100.0, 0.0) for k in range(5)], "square": [(x * 10.0, y * 10.0) for x in range(4) for y in range(4)]}
    rings = {k: hull(p) for k, p in sets.items()}
    assert rings["line"] == [(0.0, 0.0), (400.0, 0.0)] and set(rings["square"]) == {(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)}
    for k, ring in rings.items():
        assert set(ring) <= set(sets[k]) and all(away(p, ring) < 1e-6 for p in sets[k])
    points = [(i, rng.uniform(-200, 1100), rng.uniform(-200, 1100)) for i in range(400)]
    own = spark.createDataFrame([(k, i, *p) for k, ps in sets.items() for i, p in enumerate(ps)], "id string, node_id long, x double, y double")
    got = {(r["id"], r["i"]) for r in chain.inside(chain.hulls(own), spark.createDataFrame(points, "i long, x double, y double"), 50.0, 130.0).collect()}
    assert got == {(k, i) for k, ring in rings.items() for i, x, y in points if away((x, y), ring) < 50.0}


def test_place_profiles(spark, spots, city):
    own, _ = chain.shapes(spots, city.nodes, city.edges)
    rows = [(x, y, c, year) for x, y in ((50.0, 20.0), (150.0, 40.0), (130.0, 240.0), (900.0, 900.0)) for c, year in (("food", 2019), ("food", 2022), ("odd", 2019), ("bank", 2019))]
    got = {r["id"]: r.asDict() for r in chain.place_profiles(spots, own, spark.createDataFrame(rows, "x double, y double, category string, year int"), ["bank", "food", "school"], 36).collect()}
    size = {r["id"]: r["n_nodes"] for r in spots.collect()}
    line = next(k for k, r in ((r["id"], r) for r in spots.collect()) if r["nodes"] == SPOTS["2020-01_h01"])
    assert set(got) == set(size) and got[line]["year"] == 2019 and got[line]["counts"] == [2, 2, 0] and got[line]["total"] == 4
    assert got[line]["lq"] == pytest.approx([(2 / 4) / (5 / 36)] * 2 + [0.0]) and got[line]["entropy"] == pytest.approx(math.log(2)) and got[line]["per_node"] == 4 / 5
    assert any(r["total"] == 0 and r["entropy"] == 0.0 and r["counts"] == [0, 0, 0] for r in got.values())


def test_archetypes_take_each_hotspot_once_while_there_are_others(spark):
    rng = random.Random(8)
    spots, matrix = [], []
    for k in range(60):
        n = rng.choice([2, 3, 4, 8, 9, 12, 20, 50])
        m = n - 1 + rng.choice([0, 0, 1, 5])
        spots.append((f"2020-{1 + k % 9:02d}_h{k:02d}", f"2020-{1 + k % 9:02d}", [rng.randrange(300) for _ in range(n)], [(i, i + 1) for i in range(m)], n))
        matrix.append((spots[-1][0], [rng.random() for _ in range(12)], [rng.random() for _ in range(5)]))
    s = spark.createDataFrame(spots, "id string, mes string, nodes array<long>, edges array<struct<u:long,v:long>>, n_nodes int")
    got = [(r["archetype"], r["id"]) for r in chain.archetypes(s, spark.createDataFrame(matrix, "id string, structural array<double>, hierarchy array<double>")).collect()]
    nodes = {x[0]: set(x[2]) for x in spots}
    same = {a: sum(bool(nodes[a] & nodes[b]) for b in nodes if b != a) for a in nodes}
    of = {h: dict(zip(chain.STRUCTURE, v)) | {"n_nodes": x[4], "n_edges": len(x[3]), "dominance": r[-1], "major": r[0] + r[1]} for x, (h, v, r) in zip(spots, matrix)}
    python = lambda e, h: eval(e.replace("n_nodes between 3 and 4", "3 <= n_nodes <= 4").replace("n_nodes between 4 and 10", "4 <= n_nodes <= 10").replace("n_nodes between 8 and 28", "8 <= n_nodes <= 28").replace(" = ", " == "), {}, of[h])  # noqa: E731, S307
    used = set()
    for (name, what, best), (label, chosen) in zip(chain.ARCHETYPES, got, strict=True):
        fit = sorted((h for h in of if python(what, h)), key=lambda h: (*(python(x, h) for x in best.split(", ")), h))
        tiers = [[h for h in fit if h not in used and same[h] >= least] for least in (5, 1, 0)]
        want = next((t[0] for t in tiers if t), fit[0] if fit else next(h for h in sorted(of) if h not in used))
        assert (label, chosen) == (name, want)
        used.add(chosen)


def test_pair_of_hotspots(spark, spots, city):
    a, b = (next(r for r in spots.collect() if r["nodes"] == SPOTS[k]) for k in ("2020-01_h01", "2020-02_h02"))
    profiles = spark.createDataFrame([(a["id"], [2, 0], 0.5), (b["id"], [1, 3], 0.25)], "id string, counts array<long>, entropy double")
    got = {(r["part"], r["name"]): (r["a"], r["b"], r["delta"], r["side"]) for r in chain.pair(spots, profiles, ["bank", "food"], ["2020-01", "2020-02", "2020-03"], a["id"], b["id"]).collect()}
    assert got["incidents", "all"][:3] == (a["crimes"], b["crimes"], a["crimes"] - b["crimes"]) and got["places", "food"] == (0.0, 3.0, -3.0, "only b") and got["entropy", "places"][2] == 0.25
    assert [got["month", m][0] for m in ("2020-01", "2020-02", "2020-03")] == a["series"] and got["kind", "a"][0] == a["by_category"].get("a", 0)


def test_steps_along_the_network(spark, city):
    pairs = [(a, b) for a, b in itertools.product((0, 7, 20), (0, 1, 14, 35, 99))]
    got = {(r["a"], r["b"]): r["metres"] for r in chain.steps(spark.createDataFrame(pairs, "a long, b long"), city.arcs, 500.0).collect()}
    steps = lambda a, b: 100.0 * (abs(a % SIDE - b % SIDE) + abs(a // SIDE - b // SIDE)) if b < 36 else math.inf
    assert got == {(a, b): min(500.0, steps(a, b)) for a, b in pairs}


def test_trajectories(spots, city):
    tracks = chain.trajectories(spots, city.counts)
    metrics = {frozenset(r["members"]): r.asDict() for r in chain.trajectory_metrics(tracks, spots, city.arcs, 3).collect()}
    of = {tuple(r["nodes"]): r for r in spots.collect()}
    long = frozenset(of[tuple(SPOTS[k])]["id"] for k in ("2020-01_h01", "2020-02_h01"))
    assert set(metrics) == {long, *(frozenset([of[tuple(SPOTS[k])]["id"]]) for k in ("2020-01_h02", "2020-02_h02"))}
    own = metrics[long]
    a, b = of[tuple(SPOTS["2020-01_h01"])], of[tuple(SPOTS["2020-02_h01"])]
    assert own["k"] == 2 and own["frequency"] == pytest.approx(2 / 3) and own["stability"] == pytest.approx(4 / 5) and own["nodes_union"] == 5 and own["months"] == ["2020-01", "2020-02"]
    assert own["crimes"] == [a["crimes"], b["crimes"]] and own["movement_m"] == 100.0 * abs(a["seed_node"] - b["seed_node"]) and own["intensity_max"] == max(own["crimes"])
    assert all(r["stability"] is None and r["movement_m"] is None for k, r in metrics.items() if k != long)


def test_contrast_of_groups(spark):
    rng = random.Random(2)
    frequency = [(f"h{k:02d}", rng.choice([0.1, 0.2, 0.3, 0.4])) for k in range(60)]
    values = [(h, name, rng.random() + (f if name == "x" else 0)) for h, f in frequency for name in "xyz"]
    lo, hi = np.quantile([f for _, f in frequency], [1 / 3, 2 / 3])
    got = {r["name"]: r.asDict() for r in chain.contrasted(spark.createDataFrame(values, "id string, name string, value double"), chain.thirds(spark.createDataFrame(frequency, "id string, frequency double"))).collect()}
    of = dict(frequency)
    for name in "xyz":
        a, b = ([v for h, n, v in values if n == name and ok(of[h])] for ok in (lambda f: f >= hi, lambda f: f <= lo))
        u = sum((p > q) + (p == q) / 2 for p in a for q in b)
        r = got[name]
        assert r["u"] == u and r["delta"] == pytest.approx(2 * u / len(a) / len(b) - 1, abs=1e-4) and r["mean_persistent"] == pytest.approx(np.mean(a), abs=1e-4)
        assert r["p"] == pytest.approx(tracking.normal_u_p(u, len(a), len(b), 0), abs=1e-6)
    p = sorted(r["p"] for r in got.values())
    assert sorted(r["p_adj"] for r in got.values()) == pytest.approx([min(p[i] * 3 / (i + 1) for i in range(k, 3)) for k in range(3)], abs=2e-6)
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == sorted(got, key=lambda n: -abs(got[n]["delta"]))


def test_matched_candidates_are_near_in_shape_and_far_in_incidents(spark):
    rng = random.Random(5)
    rows = [(f"h{k:03d}", [rng.random() for _ in range(3)], rng.choice([0, 1, 2, 5, 10, 40]), [k // 2, 1000 + k]) for k in range(120)]
    matrix = spark.createDataFrame([(h, v) for h, v, _, _ in rows], "id string, structural array<double>")
    spots = spark.createDataFrame([(h, c, n) for h, _, c, n in rows], "id string, crimes long, nodes array<long>")
    d = lambda a, b: math.dist(a[1], b[1])
    near = np.quantile([d(a, b) for a, b in itertools.combinations(rows, 2)], 0.05)
    want = {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if d(a, b) <= near and b[2] > 0 and a[2] >= 3 * b[2] and not set(a[3]) & set(b[3])}
    assert {(r["a"], r["b"]) for r in chain.matched_candidates(matrix, spots, 0.05).collect()} == want and want


@pytest.mark.parametrize("method", ["netlsd", "scattering", "wwl", "gl2vec"])
def test_vectors_do_not_depend_on_node_ids(spark, method):
    """Of each graph and a copy with other ids, moved and in another order, the vectors are equal; for transport, the distances to all other graphs (a graph's smoothed distance to its copy is above 0)."""
    rng = random.Random(7)
    shapes = {"path": [(k, k + 1) for k in range(8)], "ring": [(k, (k + 1) % 7) for k in range(7)], "star": [(0, k) for k in range(1, 7)], "grid": [(v, w) for v in range(9) for w in (v + 1, v + 3) if w < 9 and (w - v == 3 or w % 3)]}
    nodes, arcs = [], []
    for name, edges in shapes.items():
        ids = sorted({v for e in edges for v in e})
        xy = {v: (rng.uniform(0, 300), rng.uniform(0, 300)) for v in ids}
        for copy in (0, 1):
            new = dict(zip(ids, rng.sample(range(1000 * copy, 1000 * copy + 900), len(ids)) if copy else ids))
            nodes += [(f"{name}{copy}", new[v], xy[v][0] + 500 * copy, xy[v][1] - 80 * copy) for v in ids]
            arcs += [(f"{name}{copy}", new[a], new[b], "lane" if u % 2 else "street") for u, v in edges for a, b in ((u, v), (v, u))]
    members, both = spark.createDataFrame(nodes, "id string, node_id long, x double, y double"), spark.createDataFrame(arcs, "id string, src long, dst long, road_class string")
    if method == "gl2vec":
        with pytest.warns(UserWarning):
            found = embedding.embedded(method, members, both, "id", ["lane", "street"], 4)
    else:
        found = embedding.embedded(method, members, both, "id", ["lane", "street"], 4)
    v = {r["id"]: np.array(r["vector"]) for r in found.collect()}
    assert len(v) == 8
    if method == "wwl":
        d = {frozenset([r["a"], r["b"]]): r["distance"] for r in embedding.transport_distances(embedding.node_clouds(members, both, "id", ["lane", "street"]), "id").collect()}
        for (a, b), c in itertools.product(itertools.permutations(shapes, 2), "01"):
            assert d[frozenset([f"{a}0", b + c])] == pytest.approx(d[frozenset([f"{a}1", b + c])]) and d[frozenset([f"{a}0", f"{a}1"])] < d[frozenset([f"{a}0", b + c])]
        return
    for name in shapes:
        assert v[f"{name}0"] == pytest.approx(v[f"{name}1"], abs=1e-6)
    assert all(np.abs(v[f"{a}0"] - v[f"{b}0"]).max() > 1e-3 for a, b in itertools.combinations(shapes, 2))


def test_transport_against_a_plain_version(spark):
    rng = np.random.default_rng(1)
    clouds = {f"g{k}": rng.random((int(rng.integers(2, 6)), 3)) for k in range(5)}
    got = {(r["a"], r["b"]): r["distance"] for r in embedding.transport_distances(spark.createDataFrame([(k, c.tolist()) for k, c in clouds.items()], "id string, cloud array<array<double>>"), "id", block=2).collect()}
    scale = np.vstack(list(clouds.values())).std(0)
    own = {k: c / scale for k, c in clouds.items()}
    eps = 0.5 * np.median([np.mean([np.linalg.norm(x - c.mean(0)) for x in c]) for c in own.values()])
    for a, b in itertools.combinations(sorted(own), 2):
        n, m = len(own[a]), len(own[b])
        cost = [[math.dist(p, q) for q in own[b]] for p in own[a]]
        u, w = [1.0] * n, [1.0] * m
        for _ in range(25):
            w = [1 / m / sum(math.exp(-cost[i][j] / eps) * u[i] for i in range(n)) for j in range(m)]
            u = [1 / n / sum(math.exp(-cost[i][j] / eps) * w[j] for j in range(m)) for i in range(n)]
        assert got[a, b] == pytest.approx(sum(u[i] * math.exp(-cost[i][j] / eps) * w[j] * cost[i][j] for i in range(n) for j in range(m)), abs=1e-6)


def test_coordinates_of_classes_are_those_of_all_members(spark):
    """Products of coordinates from classes and their sizes are the kernel of all pairs, whose equal clouds have a row each."""
    rng = np.random.default_rng(3)
    shapes = [rng.random((k, 2)) for k in (2, 3, 4)]
    clouds = {f"g{k}": shapes[i] for k, i in enumerate((0, 1, 0, 2, 0, 1))}
    rows = spark.createDataFrame([(k, c.tolist()) for k, c in clouds.items()], "id string, cloud array<array<double>>")
    members, pairs = embedding.transport_classes(rows, "id", block=2)
    assert {r["id"]: r["class"] for r in members.collect()} == {"g0": "g0", "g1": "g1", "g2": "g0", "g3": "g3", "g4": "g0", "g5": "g1"}
    assert sorted((r["a"], r["b"]) for r in pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).collect()) == [("g0", "g0"), ("g0", "g1"), ("g0", "g3"), ("g1", "g1"), ("g1", "g3")]
    whole = {(r["a"], r["b"]): r["distance"] for r in embedding.transport_distances(rows, "id").collect()}
    assert set(whole) == set(itertools.combinations(sorted(clouds), 2))
    names = sorted(clouds)
    matrix = np.array([[whole.get((min(a, b), max(a, b)), 0.0) for b in names] for a in names])
    kernel = np.exp(-matrix / np.median(list(whole.values())))
    centred = (kernel - kernel.mean(0)) - (kernel - kernel.mean(0)).mean(1, keepdims=True)
    for dimensions in (128, 2):
        got = {r["id"]: r["vector"] for r in embedding.kernel_coordinates(members, pairs, "id", dimensions).collect()}
        x = np.array([got[k] for k in names])
        values, vectors = np.linalg.eigh((centred + centred.T) / 2)
        best = np.argsort(-values)[:dimensions]
        assert np.allclose(x @ x.T, (vectors[:, best] * np.maximum(values[best], 0)) @ vectors[:, best].T, atol=1e-6)


def test_document_vectors_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    docs = {k: sorted(f"l{x}" for x in rng.integers(0, 6, int(rng.integers(3, 9)))) for k in range(7)}
    rows = spark.createDataFrame([(k, x) for k, own in docs.items() for x in own], "id long, label string")
    got = {r["id"]: r["vector"] for r in embedding.doc_vectors(rows, "id", 4, 6).collect()}
    codes, names = np.unique(np.concatenate([docs[k] for k in range(7)]), return_inverse=True)[1], sorted({x for own in docs.values() for x in own})
    own = np.split(codes, np.cumsum([len(docs[k]) for k in range(6)]))
    rng = np.random.default_rng(42)
    vectors, weights = (rng.random((7, 4)) - 0.5) / 4, np.zeros((len(names), 4))
    noise = np.bincount(codes, minlength=len(names)) ** 0.75
    edges = np.cumsum(noise / noise.sum())
    for epoch in range(6):
        step = 0.025 + (1e-4 - 0.025) * epoch / 5
        for i in rng.permutation(7):
            drawn = np.minimum(np.searchsorted(edges, rng.random(len(own[i]) * 5)), len(names) - 1)
            words, truth = np.concatenate([own[i], drawn]), np.repeat([1.0, 0.0], [len(own[i]), len(drawn)])
            error = step * (truth - 1 / (1 + np.exp(-weights[words] @ vectors[i])))
            change = error @ weights[words]
            np.add.at(weights, words, error[:, None] * vectors[i])
            vectors[i] += change
    assert all(np.allclose(got[k], vectors[k], atol=1e-8) for k in range(7))


def test_sown_incidents_and_their_scores(spark, city):
    counts, truth = chain.clustered_incidents(city.edges.select("u", "v"), 3, 5, 80, 40, 9)
    total = Counter()
    for r in counts.collect():
        total[r["mes"]] += r["c"]
    assert total == {f"synth_0{k}": 120 for k in range(3)}
    real = defaultdict(set)
    for r in truth.collect():
        real[r["mes"]].add(r["node_id"])
    assert len(real) == 3 and all(5 < len(v) <= 10 for v in real.values()) and len({frozenset(v) for v in real.values()}) == 3
    found = spark.createDataFrame([("synth_00", "topo", v) for v in [*sorted(real["synth_00"])[:3], 0, 35]], "mes string, method string, node_id long")
    r = chain.scored(found, truth).first()
    hit = len({*sorted(real["synth_00"])[:3], 0, 35} & real["synth_00"])
    ppv, sens = hit / r["n_detected"], hit / len(real["synth_00"])
    assert r["n_hit"] == hit and r["ppv"] == ppv and r["sensitivity"] == sens and r["f1"] == pytest.approx(2 * ppv * sens / (ppv + sens))


def test_sweep_counts_the_first_regions(spark, city):
    field = city.counts.withColumnsRenamed({"c": "f"}).select("mes", "node_id", F.col("f").cast("double").alias("f")).join(city.counts, ["mes", "node_id"])
    got = {(r["mes"], r["alpha"], r["f_min"], r["k"]): (r["captured"], r["nodes"], r["hotspots"]) for r in regions.swept(field, city.arcs, ["mes"], [0.1, 0.5], [0.0, 0.4], [1, 3]).collect()}
    for alpha, floor in itertools.product((0.1, 0.5), (0.0, 0.4)):
        spots = regions.hotspots(regions.segment(field.drop("c"), city.arcs, ["mes"], alpha, floor), city.counts, ["mes"])
        for k in (1, 3):
            want = defaultdict(lambda: [0, 0, 0])
            for r in spots.where(F.col("rank") <= k).collect():
                for i, x in enumerate((r["score"], r["n_nodes"], 1)):
                    want[r["mes"]][i] += x
            assert {m: tuple(v) for m, v in want.items()} == {m: v for (m, a, f, kk), v in got.items() if (a, f, kk) == (alpha, floor, k)}


def test_cached_tables_follow_their_inputs(spark):
    made = []
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a long, b double")
    build = lambda df: lambda: made.append(1) or df.withColumn("c", F.col("a") + 1)
    for df in (rows, rows.orderBy(F.desc("a")), rows.repartition(3)):
        assert {tuple(r) for r in storage.cached(spark, "t", {"p": 1}, [df], build(df)).collect()} == {(1, 2.0, 2), (2, 3.0, 3)}
    assert len(made) == 1
    storage.cached(spark, "t", {"p": 2}, [rows], build(rows))
    other = rows.withColumn("b", F.col("b") + F.when(F.col("a") == 2, 1e-9).otherwise(0.0))
    storage.cached(spark, "t", {"p": 1}, [other], build(other))
    assert len(made) == 3


def test_a_cluster_needs_a_shared_folder(spark):
    conf = lambda **own: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, default=None: own.get(k.replace(".", "_"), default)))
    assert storage.folder(conf(spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y" and storage.folder(conf(spark_master="local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", ""):
        with pytest.raises(ValueError):
            storage.folder(conf(spark_master=master))


# settings and commands


def test_settings(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text("active_dataset: one\ndensity: {sigma_m: 90}\nnetwork: {hierarchy: {avenue: [primary], street: [road]}}\ndatasets:\n  one: {data: {crimes_csv: a.csv}, network: {hierarchy: {street: [track]}}, hotspots: {alpha: auto}}\n  two: {density: {sigma_m: -1}}\n  three: {pois: {source: geofabrik}}\n  four: {data: {month_from: '2020-13'}}\n")
    one = config.load(str(path))
    assert one.name == "one" and one["density.sigma_m"] == 90 and one["density.truncate_sigmas"] == 3.0 and one.under("network.hierarchy") == {"avenue": ["primary"], "street": ["track"]}
    assert one.file("data.crimes_csv") == str(tmp_path / "a.csv") and one.number("density.sigma_m") == 90.0 and one.number("hotspots.alpha", {"recommended": {"alpha": 0.2}}) == 0.2
    with pytest.raises(ValueError, match="calibration"):
        one.number("hotspots.alpha")
    for name, what in (("two", "density.sigma_m"), ("three", "pois.region"), ("four", "month_from"), ("five", "there are")):
        with pytest.raises(ValueError, match=what):
            config.load(str(path), name)
    assert config.datasets(str(path)) == ["one", "two", "three", "four"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A small city: a lattice as GraphML, incidents as CSV, places as Parquet, and settings."""
    pytest.importorskip("yaml")
    import pyarrow as pa
    import pyarrow.parquet as pq

    here, rng = tmp_path_factory.mktemp("city"), random.Random(3)
    at = lambda v: (41.88 + (v // SIDE) * 0.0009, -87.63 + (v % SIDE) * 0.0012)
    node = "".join(f'<node id="{v}"><data key="x">{at(v)[1]}</data><data key="y">{at(v)[0]}</data></node>' for v in range(36))
    edge = "".join(f'<edge source="{u}" target="{v}"><data key="l">100.0</data><data key="h">{"primary" if v - u > 1 else "residential"}</data></edge>' for u, v in EDGES)
    (here / "g.graphml").write_text(f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="x" attr.name="x"/><key id="y" attr.name="y"/><key id="l" attr.name="length"/><key id="h" attr.name="highway"/><graph>{node}{edge}</graph></graphml>')
    lines = ["ID,Date,Primary Type,Description,Location Description,Latitude,Longitude"]
    for k in range(300):
        v = rng.choice([7, 7, 7, 8, 13, 28, 28, 27, rng.randrange(36)])
        lat, lon = at(v)
        lines.append(f"{k},{1 + k % 3:02d}/1{k % 9}/2020 10:00:00 AM,{rng.choice(['THEFT', 'ROBBERY'])},X,STREET,{lat + rng.uniform(-2e-4, 2e-4):.6f},{lon + rng.uniform(-2e-4, 2e-4):.6f}")
    lines += [lines[1], "900,01/10/2020 10:00:00 AM,THEFT,X,STREET,99,-87.6", "901,01/10/2020 10:00:00 AM,THEFT,X,STREET,41.0,-87.6"]
    (here / "in.csv").write_text("\n".join(lines) + "\n")
    pq.write_table(pa.table({"lat": [at(v)[0] for v in (7, 7, 28, 0)], "lon": [at(v)[1] for v in (7, 7, 28, 0)], "amenity": ["cafe", "bank", "cafe", "tomb"], "shop": pa.nulls(4, pa.string()), "leisure": pa.nulls(4, pa.string()), "year": pa.array([2020] * 4, pa.int32())}), here / "raw.parquet")
    (here / "tax.yaml").write_text("categories: [food, money]\ntags: {food: {amenity: [cafe]}, money: {amenity: [bank]}}\n")
    (here / "c.yaml").write_text(
        """active_dataset: toy
network: {hierarchy: {avenue: [primary], street: [residential]}}
density: {sigma_m: 120.0}
hotspots: {alpha: 0.1, top_k: 3}
pois: {taxonomy: tax.yaml, raw: raw.parquet, cache: places.parquet}
features: {embedding: {method: netlsd, dimensions: 4, compare: [wwl]}}
datasets:
  toy: {label: Toy, data: {crimes_csv: in.csv, processed_dir: out, source_profile: chicago, month_from: "2020-01"}, network: {cache: g.graphml}}
"""
    )
    return here


def test_commands(spark, files, capsys, monkeypatch):
    monkeypatch.setattr("citadine.session.local", lambda *a, **k: spark)
    run = lambda *args: cli.main([*args, "--config", str(files / "c.yaml")])
    for command in ("ingest", "pois", "calibrate", "hotspots", "evaluate", "features", "export", "casestudies"):
        assert run(command) == 0
    assert run("benchmark", "--realisations", "2", "--subnetwork", "25", "--parents", "4") == 0
    assert run("index", "--out", str(files / "datasets.json")) == 0
    read = lambda name: json.loads((files / "out" / name).read_text())
    report = read("validation_report.json")
    assert (report["total_rows"], report["kept_rows"], report["duplicate_rows"], report["discarded_rows"]) == (303, 301, 1, 1)
    spots = read("hotspots.json")
    assert spots["summary"]["crimes_snapped"] == 300 and spots["summary"]["network_nodes"] == 36 and spots["months"] == ["2020-01", "2020-02", "2020-03"] and 0 < len(spots["hotspots"]) <= 9
    assert all(h["crimes"] == sum(h["by_category"].values()) == h["series"][spots["months"].index(h["mes"])] for h in spots["hotspots"])
    assert spots["summary"]["lift"] == round(spots["summary"]["density_hotspots"] / spots["summary"]["city_mean_density"], 2)
    sweep = read("param_sweep.json")
    assert len(sweep["grid"]) == 180 and sum(r["recommended"] for r in sweep["grid"]) == 1 and len(sweep["k_sweep"]) == 6 and set(read("calibration.json")["recommended"]) == {"sigma_m", "alpha", "f_min_ratio"}
    evaluation = read("evaluation.json")
    assert {r["method"] for r in evaluation["methods"]} == {"topo", "greedy", "bfs"} and (files / "out/evaluation.csv").read_text().splitlines()[0].startswith("month,crimes,topo_captured,topo_coverage")
    alike = read("similarity.json")
    assert set(alike["methods"]) == {"netlsd", "wwl"} and len(alike["hotspots"]) == len(spots["hotspots"]) and sum(h["pois"]["total"] for h in alike["hotspots"]) > 0 and all(len(h["structural"]) == 12 for h in alike["hotspots"])
    shapes = read("hotspots.geojson")["features"]
    assert {f["properties"]["part"] for f in shapes} == {"area", "lines", "seed"} and len(shapes) == 3 * len(spots["hotspots"])
    assert len((files / "out/snapping.bin").read_bytes()) == 4 * 301 + 4 * 36
    studies = read("casestudies.json")
    assert sum(t["k"] for t in studies["trajectories"]) == len(spots["hotspots"]) and len(studies["topology_contrast"]) == 15
    assert {r["method"] for r in read("benchmark.json")["methods"]} == {"topo", "greedy", "bfs"}
    index = json.loads((files / "datasets.json").read_text())
    assert index["default"] == "toy" and {"evaluation.json", "hotspots.geojson", "pois.bin"} <= set(index["datasets"][0]["has"]) and index["datasets"][0]["label"] == "Toy"
    assert "knee" in capsys.readouterr().out


def test_artifacts_of_plain_values(tmp_path):
    artifacts.write_json({"a": float("nan"), "b": np.int64(3), "c": (1, {"d": np.float64(0.5)}), 4: None}, str(tmp_path / "x/y.json"))
    assert artifacts.read_json(str(tmp_path / "x/y.json")) == {"a": None, "b": 3, "c": [1, {"d": 0.5}], "4": None}
    artifacts.write_csv(["a", "b"], [{"b": 1, "c": 2}], str(tmp_path / "z.csv"))
    assert (tmp_path / "z.csv").read_text().split() == ["a,b", ",1"]
    assert artifacts.dataset_index({"x": {"dir": str(tmp_path)}}) == {"default": None, "datasets": []}
