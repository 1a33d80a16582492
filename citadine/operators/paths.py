"""Centrality of small graphs, and the crop of a network around a seed."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def betweenness_and_closeness(neighbours: dict[int, list[int]], sources: int = 50) -> tuple[float, float]:
    """Mean normalised betweenness, from up to ``sources`` evenly spaced sources, and mean closeness over the nodes that each can reach."""
    nodes = sorted(neighbours)
    n = len(nodes)
    if n < 2:
        return 0.0, 0.0
    picked = nodes if n <= sources else [nodes[int(k * n / sources)] for k in range(sources)]
    between, close = dict.fromkeys(nodes, 0.0), []
    for s in nodes:
        order, far, ways, before = [], {s: 0}, {s: 1}, {s: []}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for u in neighbours[v]:
                if u not in far:
                    far[u], ways[u], before[u] = far[v] + 1, 0, []
                    queue.append(u)
                if far[u] == far[v] + 1:
                    ways[u] += ways[v]
                    before[u].append(v)
        total = sum(far.values())
        close.append((len(far) - 1) / total * (len(far) - 1) / (n - 1) if total else 0.0)
        if s in picked:
            share = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                for u in before[v]:
                    share[u] += ways[u] / ways[v] * (1 + share[v])
                if v != s:
                    between[v] += share[v]
    scale = n / len(picked) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return sum(between.values()) * scale / n, sum(close) / n


def centrality(members: DataFrame, arcs: DataFrame, key: str) -> DataFrame:
    """Mean betweenness and closeness of each region's graph."""

    def run(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame({key: [], "betweenness": [], "closeness": []})
        near = {v: [] for v in nodes["node_id"].tolist()}
        for a, b in zip(pairs["src"].tolist(), pairs["dst"].tolist()):
            near[a].append(b)
        b, c = betweenness_and_closeness(near)
        return pd.DataFrame({key: [nodes[key].iloc[0]], "betweenness": [round(b, 9)], "closeness": [round(c, 9)]})

    return members.groupBy(key).cogroup(arcs.groupBy(key)).applyInPandas(run, f"{key} {dict(members.dtypes)[key]}, betweenness double, closeness double")


def crop(arcs: DataFrame, seed: int, size: int) -> DataFrame:
    """The ``size`` nodes nearest to ``seed`` by number of arcs, smaller ids first among equals: node_id, hops.

    Each ring reads the arcs that leave the ring before it; what the driver holds is the crop, of at most ``size`` nodes."""
    inside, ring = {seed: 0}, [seed]
    while ring and len(inside) < size:
        hops = inside[ring[0]] + 1
        near = arcs.where(F.col("src").isin(ring)).select("dst").distinct().where(~F.col("dst").isin(list(inside))).orderBy("dst").limit(size - len(inside)).collect()
        ring = [r["dst"] for r in near]
        inside |= dict.fromkeys(ring, hops)
    return arcs.sparkSession.createDataFrame(list(inside.items()), "node_id long, hops int")
