"""What regions look like: shape, road hierarchy, places around them, and how alike they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine.functions.statistics import entropy_term


def structural(members: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """Twelve numbers of each region's graph: eight of its connections, four of its geometry. ``members`` has by, node_id, x, y; ``edges`` by, u, v, no counts.

    Elongation is the square root of the ratio of the covariance's eigenvalues, by the closed form for two dimensions. Joins with members are merges, none is a broadcast of them."""
    members = members.hint("merge")
    ends = edges.select(by, F.col("u").alias("node_id")).unionByName(edges.select(by, F.col("v").alias("node_id")))
    degree = members.join(ends.groupBy(by, "node_id").agg(F.count("*").alias("deg")), [by, "node_id"], "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    n, m = F.count("*"), F.sum("deg") / 2
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    vx, vy, cxy = F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")
    centre = degree.groupBy(by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    a = F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)
    nodes = degree.join(centre, by).groupBy(by).agg(
        F.log1p(n).alias("log_nodes"),
        F.log1p(m).alias("log_edges"),
        F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"),
        (2 * m / n).alias("mean_degree"),
        *[share(F.col("deg") == k).alias(f"degree_{k}") for k in (1, 2, 3)],
        share(F.col("deg") >= 4).alias("degree_4"),
        F.sqrt(F.avg(a)).alias("gyration"),
        vx.alias("vx"),
        vy.alias("vy"),
        cxy.alias("cxy"),
    )
    mean, gap = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.col("cxy") * F.col("cxy"))
    nodes = nodes.withColumn("elongation", F.when(mean + gap > 1e-12, F.sqrt(F.greatest(mean - gap, F.lit(0.0)) / (mean + gap))).otherwise(0.0)).drop("vx", "vy", "cxy")
    xy = lambda p: members.select(by, F.col("node_id").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    length = F.sqrt(F.pow(F.col("ux") - F.col("vx"), 2) + F.pow(F.col("uy") - F.col("vy"), 2))
    lengths = edges.join(xy("u"), [by, "u"]).join(xy("v"), [by, "v"]).groupBy(by).agg(F.avg(length).alias("edge_mean"), F.coalesce(F.stddev_pop(length) / F.avg(length), F.lit(0.0)).alias("edge_cv"))
    return nodes.join(lengths, by, "left").fillna(0.0, ["edge_mean", "edge_cv"])


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to [0, 1] over all rows, 0 for a constant one; the bounds are one row that joins every row."""
    bounds = df.agg(*[x for c in columns for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
    out = df.crossJoin(F.broadcast(bounds))
    scaled = {c: F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))).otherwise(0.0) for c in columns}
    return out.withColumns(scaled).select(df.columns)


def hierarchy(edges: DataFrame, by: str, classes: list[str]) -> DataFrame:
    """Shares of road classes among a region's edges, and the largest share."""
    shares = [F.avg(F.when(F.col("road_class") == c, 1.0).otherwise(0.0)).alias(c) for c in classes]
    return edges.where(F.col("road_class").isin(classes)).groupBy(by).agg(*shares).withColumn("dominance", F.greatest(*classes))


def entropy(counts: DataFrame, by: str, k: int) -> DataFrame:
    """Shannon entropy in nats of counts c by category, and over ln k."""
    total = F.sum("c").over(Window.partitionBy(by))
    return counts.withColumn("__t", total).groupBy(by).agg(F.sum(entropy_term(F.col("c"), F.col("__t"))).alias("entropy")).withColumn("entropy_norm", F.col("entropy") / F.log(F.lit(float(k))))


def zscores(long: DataFrame, dim: str, value: str) -> DataFrame:
    """Standardised by dimension with the population deviation; 0 for a constant one."""
    stats = long.groupBy(dim).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return long.join(F.broadcast(stats), dim).withColumn(value, F.when(F.col("__s") > 1e-12, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    return dot(a, b) / F.when(norm(a) > 0, norm(a)).otherwise(1.0) / F.when(norm(b) > 0, norm(b)).otherwise(1.0)


def jaccard_pairs(baskets: DataFrame, key: str, item: str, least: int = 1) -> DataFrame:
    """Overlap of all pairs of baskets with a common item, by the items that they share; an item's baskets are joined with each other, so items in very many
    baskets should be left out before."""
    sizes = baskets.groupBy(key).agg(F.count_distinct(item).alias("n"))
    own = baskets.select(key, item).distinct().join(sizes, key)
    a, b = own.select(F.col(key).alias("a"), item, F.col("n").alias("na")), own.select(F.col(key).alias("b"), item, F.col("n").alias("nb"))
    pairs = a.join(b, item).where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return pairs.where(F.col("common") >= least).select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def wl_labels(members: DataFrame, arcs: DataFrame, by: str, rounds: int) -> DataFrame:
    """Labels of every node after each round of neighbourhood refinement: by, node_id, round, label. Neighbours are sorted, so ids don't matter."""
    degree = arcs.groupBy(by, F.col("src").alias("node_id")).agg(F.count("*").alias("deg"))
    label = members.select(by, "node_id").join(degree, [by, "node_id"], "left").select(by, "node_id", F.concat(F.lit("d"), F.coalesce("deg", F.lit(0)).cast("string")).alias("label"))
    out = label.withColumn("round", F.lit(0))
    for k in range(1, rounds + 1):
        near = arcs.join(label.select(by, F.col("node_id").alias("dst"), F.col("label").alias("other")), [by, "dst"]).groupBy(by, F.col("src").alias("node_id")).agg(F.array_join(F.sort_array(F.collect_list("other")), ",").alias("near"))
        label = label.join(near, [by, "node_id"], "left").select(by, "node_id", F.substring(F.sha2(F.concat_ws("|", "label", F.coalesce("near", F.lit(""))), 256), 1, 16).alias("label"))
        out = out.unionByName(label.withColumn("round", F.lit(k)))
    return out
