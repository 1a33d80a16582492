"""Which candidates are hotspots, and the metrics of a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine import storage
from citadine.operators import regions


def select_fixed(scored: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def select_percentile(scored: DataFrame, by: list[str], q: float, order: list[Column], min_k: int = 1, max_k: int | None = None) -> DataFrame:
    """Scores at or above the exact linear quantile; at least the ``min_k`` first by score, at most the first ``max_k``."""
    at = scored.groupBy(*by).agg(F.percentile("score", F.lit(q)).alias("threshold"))
    ranked = scored.join(at, by).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = (F.col("score") >= F.col("threshold")) | (F.col("rank") <= min_k)
    return ranked.where(kept & (F.col("rank") <= max_k) if max_k else kept)


def select_montecarlo(scored: DataFrame, null_max: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """p = (1 + replicates at least as high) / (1 + replicates), kept below ``alpha``; without replicates nothing is kept.

    The null is a few values per group, gathered as an array."""
    nulls = null_max.groupBy(*by).agg(F.collect_list("value").alias("null"))
    joined = scored.join(nulls, by)
    p = (F.size(F.filter("null", lambda t: t >= F.col("llr"))) + 1) / (F.size("null") + 1)
    return joined.withColumn("p_value", p).withColumn("kept", p < alpha).drop("null")


def clamped(judged: DataFrame, by: list[str], order: list[Column], min_k: int = 0, max_k: int | None = None) -> DataFrame:
    """The rows with ``kept``, at most the first ``max_k``; where they are fewer than ``min_k``, the first ``min_k`` of all instead."""
    w = Window.partitionBy(*by)
    out = judged.withColumns({"__n": F.count_if("kept").over(w), "rank": F.row_number().over(w.orderBy(*order)), "__k": F.count_if("kept").over(w.orderBy(*order))})
    some = F.col("kept") & (F.col("__k") <= max_k) if max_k else F.col("kept")
    return out.where(F.when(F.col("__n") < min_k, F.col("rank") <= min_k).otherwise(some)).drop("__n", "__k", "kept")


def resolve(method: str, scored: DataFrame, by: list[str], order: list[Column], **options) -> DataFrame:
    """The selection by its name: fixed (k), percentile (q, min_k, max_k) or montecarlo (null_max, alpha, min_k, max_k)."""
    if method == "fixed":
        return select_fixed(scored, by, options["k"], order)
    if method == "percentile":
        return select_percentile(scored, by, options["q"], order, options.get("min_k", 1), options.get("max_k"))
    if method == "montecarlo":
        return clamped(select_montecarlo(scored, options["null_max"], by, options["alpha"]), by, order, options.get("min_k", 0), options.get("max_k"))
    raise ValueError(f"unknown selection {method!r}; there are fixed, percentile and montecarlo")


def metrics(members: DataFrame, by: list[str], total: Column, network: Column) -> DataFrame:
    """captured, coverage, nodes, density and hotspots of selected nodes with their counts c and hotspot id."""
    captured, nodes = F.sum("c"), F.count("*")
    return members.groupBy(*by).agg(captured.cast("long").alias("captured"), F.round(captured / F.max(total), 5).alias("coverage"), nodes.alias("nodes"), F.round(captured / nodes, 4).alias("density"), F.round(nodes / F.max(network), 6).alias("footprint"))


def pareto(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Points that no other one equals or beats in both and beats in one; equal points all stay."""
    ahead = Window.partitionBy(*by).orderBy(F.desc(x)).rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*by, x)
    better = F.max(y).over(ahead)
    return points.withColumn("__better", better).withColumn("__same", F.max(y).over(same)).where((F.col(y) == F.col("__same")) & (F.col("__better").isNull() | (F.col("__better") < F.col(y)))).drop("__better", "__same")


def knee(front: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The point farthest from the chord between the first and last by x, both axes scaled to [0, 1]; its distance is the curvature.

    Of fewer than three points the last, and of a flat axis the middle one, with curvature 0."""
    w = Window.partitionBy(*by)
    lo = lambda c: F.min(c).over(w)
    hi = lambda c: F.max(c).over(w)
    order = w.orderBy(x, F.desc(y))
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scaled = front.withColumns({"__n": F.count("*").over(w), "__i": F.row_number().over(order) - 1, "__xr": hi(x) - lo(x), "__yr": hi(y) - lo(y), "__x": F.try_divide(F.col(x) - lo(x), hi(x) - lo(x)), "__y": F.try_divide(F.col(y) - lo(y), hi(y) - lo(y))})
    scaled = scaled.withColumns({"__x0": F.first("__x").over(full), "__y0": F.first("__y").over(full), "__x1": F.last("__x").over(full), "__y1": F.last("__y").over(full)})
    dx, dy = F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")
    off = F.try_divide(F.abs(dy * (F.col("__x") - F.col("__x0")) - dx * (F.col("__y") - F.col("__y0"))), F.sqrt(dx * dx + dy * dy))
    few, flat = F.col("__n") < 3, (F.col("__xr") <= 0) | (F.col("__yr") <= 0)
    chosen = F.when(few, F.col("__i") == F.col("__n") - 1).when(flat, F.col("__i") == F.floor(F.col("__n") / 2))
    scaled = scaled.withColumn("curvature", F.when(few | flat, 0.0).otherwise(F.round(off, 9)))
    scaled = scaled.withColumn("__r", F.row_number().over(w.orderBy(F.desc(F.coalesce(chosen, F.lit(False)).cast("int")), F.desc("curvature"), "__i")))
    return scaled.where("__r = 1").select(*by, x, y, "curvature")


def fields_of(counts: DataFrame, distances: DataFrame, sigmas: list[float], truncate: float) -> DataFrame:
    """The fields of all sigmas with their counts: mes, node_id, c, sigma, f; one sum for each sigma, null without a source in its reach. The joins are merges: files say too little of how many
    rows they hold to let them choose a broadcast."""
    own, d = counts.select("mes", F.col("node_id").alias("src"), "c"), F.col("d")
    sums = [F.sum(F.when(d <= truncate * s, F.col("c") * F.exp(-d * d / (2 * s * s)))) for s in map(float, sigmas)]
    each = F.array(*[F.struct(F.lit(float(s)).alias("sigma"), x.alias("f")) for s, x in zip(sigmas, sums)])
    f = own.join(distances.hint("merge"), "src").groupBy("mes", F.col("dst").alias("node_id")).agg(each.alias("each"))
    f = f.join(counts.hint("merge"), ["mes", "node_id"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return f.select("mes", "node_id", "c", F.inline("each")).where("f is not null")


def swept(counts: DataFrame, distances, arcs: DataFrame, network_nodes: int, sigmas: list[float], alphas: list[float], floors: list[float], ks: list[int], truncate: float = 3.0) -> DataFrame:
    """One row for each sigma, alpha, f_min and k over all months (mes): captured, nodes, hotspots, coverage, nodes_per_month, density, lift.

    ``distances`` (rows, or a broadcast by ``regions.packed_kernel``) reach ``truncate`` times the largest sigma; each sigma's field takes what is within its own reach. Coverage and density are rounded before anything follows from them. A month's field
    is made and swept in one task's arrays or, where the kernel is too large for that, as rows."""
    months = regions.gathered(counts, ["mes"])
    grid = regions.swept_fields(months, distances, arcs, ["mes"], sigmas, truncate, alphas, floors, ks)
    if grid is None:
        grid = regions.swept(fields_of(counts, distances, sigmas, truncate), arcs, ["mes", "sigma"], alphas, floors, ks)
    total = months.agg(F.sum("n").alias("total"), F.count("mes").alias("months"))
    out = grid.groupBy("sigma", "alpha", "f_min", "k").agg(*[F.sum(c).cast("long").alias(c) for c in ("captured", "nodes", "hotspots")]).crossJoin(F.broadcast(total))
    density = F.coalesce(F.try_divide("captured", "nodes"), F.lit(0.0))
    mean = F.col("total") / F.col("months") / F.lit(network_nodes)
    return out.select(
        "sigma", "alpha", "f_min", "k", "captured", "nodes", "hotspots",
        F.round(F.try_divide("captured", "total"), 5).alias("coverage"),
        F.round(F.col("nodes") / F.col("months"), 1).alias("nodes_per_month"),
        F.round(density, 4).alias("density"),
        F.round(F.try_divide(density, mean), 3).alias("lift"),
    )


def calibrated(grid: DataFrame) -> DataFrame:
    """The grid, saved, with pareto (on the front of coverage and density), recommended (the front's knee), its curvature, and alpha_sensitivity: the relative range of coverage over
    alpha at the knee's sigma and floor. The grid is some hundreds of rows."""
    grid = storage.saved(grid, "sweep")
    one = grid.withColumn("g", F.lit(0))
    front = pareto(one, ["g"], "coverage", "density")
    bend = knee(front, ["g"], "coverage", "density").select(F.col("coverage").alias("kc"), F.col("density").alias("kd"), "curvature")
    marked = grid.join(front.select("sigma", "alpha", "f_min", "k", F.lit(True).alias("pareto")), ["sigma", "alpha", "f_min", "k"], "left").withColumn("pareto", F.coalesce("pareto", F.lit(False)))
    marked = marked.crossJoin(F.broadcast(bend)).withColumn("at", F.col("pareto") & (F.col("coverage") == F.col("kc")) & (F.col("density") == F.col("kd")))
    marked = marked.withColumn("recommended", F.col("at") & (F.row_number().over(Window.orderBy(F.desc("at"), "sigma", "alpha", "f_min", "k")) == 1))
    own = Window.partitionBy("sigma", "f_min", "k")
    hi, lo = F.max("coverage").over(own), F.min("coverage").over(own)
    spread = F.when((F.count("*").over(own) < 2) | (hi == 0), 0.0).otherwise((hi - lo) / hi)
    return marked.withColumn("alpha_sensitivity", F.when(F.col("recommended"), F.round(spread, 6))).withColumn("curvature", F.when(F.col("recommended"), F.col("curvature"))).drop("kc", "kd", "at")
