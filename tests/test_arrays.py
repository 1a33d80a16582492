"""Kernels, sweeps and null replicates in arrays give what rows give, and no row per node or pair is made."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citadine.operators import field, network, regions, selecting

GRID = {"sigmas": [60.0, 120.0], "alphas": [0.05, 0.2, 0.5], "floors": [0.02, 0.1, 0.3], "ks": [2, 20]}


@pytest.fixture(scope="module")
def town(spark):
    """Arcs, counts and pairs of a lattice of 12 columns."""
    edges = [(v, w, 80.0 + (37 * v + 11 * (w - v)) % 61) for v in range(144) for w in (v + 1, v + 12) if w < 144 and (w > v + 1 or w % 12)]
    arcs = network.both_ways(spark.createDataFrame(edges, "u long, v long, length double")).cache()
    rng = np.random.default_rng(5)
    rows = [(m, int(v), int(c)) for m in ("a", "b") for v, c in enumerate(rng.poisson(0.6, 150)) if c]  # the last six have no arc
    return arcs, spark.createDataFrame(rows, "mes string, node_id long, c long").cache(), field.kernel(arcs, 360.0, 80.0).cache()


def test_kernel_in_arrays_is_that_of_rows(spark, town, monkeypatch):
    arcs, _, near = town
    want = {tuple(r) for r in near.select("src", "dst", "d").collect()}
    assert {tuple(r) for r in regions.kernel_in_arrays(arcs, 360.0, 5).collect()} == want
    shared = regions.packed_kernel(arcs, 360.0, 5).value
    net = shared.network
    assert set(zip(np.repeat(net.ids, np.diff(net.start)).tolist(), net.ids[net.to].tolist(), shared.lengths.tolist())) == want
    monkeypatch.setattr(field, "kernel", lambda *a: pytest.fail("paths became rows"))
    assert {tuple(r) for r in field.stored_kernel(arcs, 360.0, 80.0).collect()} == want
    monkeypatch.setattr(regions, "MOST_PAIRS", 10)
    assert regions.packed_kernel(arcs, 360.0, 5) is None


def test_sweep_in_arrays_is_that_of_rows(town, monkeypatch):
    arcs, counts, near = town
    got = lambda distances: sorted(map(tuple, selecting.swept(counts, distances, arcs, 150, **GRID).collect()))
    with monkeypatch.context() as m:
        m.setattr(regions, "MOST_PAIRS", 10)
        rows = got(near)
    monkeypatch.setattr(selecting, "fields_of", lambda *a: pytest.fail("fields became rows"), raising=False)
    assert len(rows) == 36 and got(near) == rows and got(regions.packed_kernel(arcs, 360.0, 5)) == rows


def test_a_threshold_joins_a_forest_once(town, monkeypatch):
    """All floors are cuts of the same joins: each cut is what the places above it alone give."""
    arcs = town[0].select("src", "dst").toPandas()
    net, rng, called = regions.Network.of(arcs["src"].to_numpy(), arcs["dst"].to_numpy()), np.random.default_rng(2), []
    joins = regions.Forest.joins
    monkeypatch.setattr(regions.Forest, "joins", lambda self, tau: called.append(tau) or joins(self, tau))
    for levels in (4, 12, 10**6):
        heights, counts = rng.integers(1, levels + 1, 144) / levels, rng.integers(0, 3, 144)
        whole = regions.Forest(net.ids, heights, *net.within(net.ids))
        sizes = [20, 70, 110, 144]
        for tau in (0.05, 0.2, 0.5):
            called.clear()
            found = whole.sums(tau, sizes, counts[whole.order])
            assert called == [tau]
            for size, (nodes, captured) in zip(sizes, found):
                top = np.sort(whole.order[:size])
                part = regions.Forest(net.ids[top], heights[top], *net.within(net.ids[top]))
                home, _ = part.regions(tau)
                want = [(int((home == p).sum()), int(counts[top][part.order][home == p].sum())) for p in np.unique(home)]
                assert [(int(a), int(b)) for a, b in zip(nodes, captured) if a] == want


def test_null_of_a_large_kernel_stays_in_arrays(spark, town, monkeypatch):
    """A kernel of more pairs than MOST_ARCS goes to the tasks as well, packed without rows."""
    arcs, counts, near = town
    nodes = spark.range(150).select(F.col("id").alias("node_id"), F.col("id").alias("idx"))
    null = lambda distances: sorted(map(tuple, regions.null_highest(counts, nodes, arcs, distances, ["mes"], 5, 7, 120.0, 0.15, 0.2).withColumn("value", F.round("value", 6)).collect()))
    first = null(near)
    monkeypatch.setattr(regions, "MOST_ARCS", arcs.count())
    assert near.count() > regions.MOST_ARCS and len(first) == 10 and null(near) == first and null(regions.packed_kernel(arcs, 360.0, 5)) == first
