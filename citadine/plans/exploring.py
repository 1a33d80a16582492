"""Exploratory tables, the dashboard's aggregates, and the stream."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine.plans.registry import query
from citadine.plans.surrogate import counts, incidents, nodes, sql, table


@query("eda_nulls", "SELECT count(*) AS n, round(avg((props IS NULL)::INT), 6) AS props_null, round(avg((value IS NULL)::INT), 6) AS value_null, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def eda_nulls(spark, d):
    share = lambda c: F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"{c}_null")
    return table(spark, d, "events").agg(F.count("*").alias("n"), share("props"), share("value"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("eda_value_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def eda_value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("eda_dup_histogram", "SELECT k AS copies, count(*) AS keys FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY k")
def eda_dup_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("keys"))


@query("eda_crosstab", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus")
def eda_crosstab(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")), 6))


@query("eda_hour_weekday", "SELECT CAST(hour(ts - INTERVAL 5 HOUR) AS INTEGER) AS hour, CAST((dayofweek(ts - INTERVAL 5 HOUR) + 6) % 7 AS INTEGER) AS weekday, count(*) AS n FROM events GROUP BY ALL")
def eda_hour_weekday(spark, d):
    local = F.col("ts") - F.expr("interval 5 hours")
    return table(spark, d, "events").groupBy(F.hour(local).alias("hour"), F.weekday(local).alias("weekday")).agg(F.count("*").alias("n"))


@query("eda_funnel", "SELECT count(*) AS documents, count(l.doc_id) AS labelled, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.quality = 1 AND l.toxic = 0) AS clean FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def eda_funnel(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "labelled_id")
    out = table(spark, d, "documents").select("doc_id").join(labels, F.col("doc_id") == F.col("labelled_id"), "left")
    return out.agg(F.count("*").alias("documents"), F.count("labelled_id").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))


@query("filtered_totals", sql("SELECT tipo, count(*) AS n FROM incidents WHERE mes BETWEEN '1996-06' AND '1998-05' AND tipo <> '5-LOW' GROUP BY tipo"))
def filtered_totals(spark, d):
    return incidents(spark, d).where("mes between '1996-06' and '1998-05' and tipo <> '5-LOW'").groupBy("tipo").agg(F.count("*").alias("n"))


@query("filtered_node_load", sql("SELECT node_id, count(*) AS n FROM incidents WHERE mes BETWEEN '1996-06' AND '1998-05' AND tipo IN ('1-URGENT', '3-MEDIUM') GROUP BY node_id"))
def filtered_node_load(spark, d):
    return incidents(spark, d).where("mes between '1996-06' and '1998-05' and tipo in ('1-URGENT', '3-MEDIUM')").groupBy("node_id").agg(F.count("*").alias("n"))


@query("dense_node_load", sql("SELECT n.node_id, coalesce(sum(c), 0)::BIGINT AS c FROM nodes n LEFT JOIN counts USING (node_id) GROUP BY n.node_id"))
def dense_node_load(spark, d):
    own = counts(spark, d).groupBy("node_id").agg(F.sum("c").alias("c"))
    return nodes(spark, d).select("node_id").join(own, "node_id", "left").fillna(0)


@query("global_timeline", sql("WITH m AS (SELECT mes, sum(c) AS n FROM counts GROUP BY mes) SELECT m.mes, CAST(n AS BIGINT) AS n, coalesce(k.marked, 0) AS marked FROM m LEFT JOIN (SELECT mes, count(*) AS marked FROM counts JOIN nodes USING (node_id) WHERE zone = 0 GROUP BY mes) k USING (mes)"))
def global_timeline(spark, d):
    marked = counts(spark, d).join(nodes(spark, d).where("zone = 0").select("node_id"), "node_id").groupBy("mes").agg(F.count("*").alias("marked"))
    return counts(spark, d).groupBy("mes").agg(F.sum("c").alias("n")).join(marked, "mes", "left").fillna(0, ["marked"])


@query("focus_set", sql("SELECT DISTINCT zone, mes FROM counts JOIN nodes USING (node_id) WHERE zone IN (SELECT DISTINCT zone FROM nodes WHERE x < 1500 AND y < 800) AND mes BETWEEN '1997-01' AND '1997-12'"))
def focus_set(spark, d):
    focus = nodes(spark, d).where("x < 1500 and y < 800").select("zone").distinct()
    return counts(spark, d).where("mes between '1997-01' and '1997-12'").join(nodes(spark, d).select("node_id", "zone"), "node_id").join(focus, "zone", "left_semi").select("zone", "mes").distinct()


OFFSETS, CELL, SPREAD = range(-3, 4), 200.0, 200.0
RELIEF = [(k, math.exp(-((k * CELL) ** 2) / (2 * SPREAD**2))) for k in OFFSETS]
_w = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in RELIEF)


_relief = f"k(o, w) AS (VALUES {_w}), b AS (SELECT CAST(floor(x / 200) AS BIGINT) AS cx, CAST(floor(y / 200) AS BIGINT) AS cy, sum(c) AS c FROM counts JOIN nodes USING (node_id) GROUP BY ALL), h AS (SELECT cx + o AS cx, cy, sum(c * w) AS v FROM b, k GROUP BY cx + o, cy), v AS (SELECT cx, cy + o AS cy, sum(v * w) AS v FROM h, k GROUP BY cx, cy + o)"


def relief(spark, d):
    """Incidents in square cells, smoothed by two one-dimensional passes."""
    binned = counts(spark, d).join(nodes(spark, d).select("node_id", "x", "y"), "node_id").groupBy(F.floor(F.col("x") / CELL).alias("cx"), F.floor(F.col("y") / CELL).alias("cy")).agg(F.sum("c").alias("v"))
    weights = F.array(*[F.struct(F.lit(k).alias("o"), F.lit(w).alias("w")) for k, w in RELIEF])
    for c, other in (("cx", "cy"), ("cy", "cx")):
        spread = binned.withColumn("k", F.explode(weights)).select((F.col(c) + F.col("k.o")).alias(c), other, (F.col("v") * F.col("k.w")).alias("v"))
        binned = spread.groupBy(c, other).agg(F.sum("v").alias("v"))
    return binned


@query("planar_relief", sql(f"WITH {_relief} SELECT cx, cy, round(v, 4) AS v FROM v QUALIFY v >= 0.02 * max(v) OVER ()"))
def planar_relief(spark, d):
    """The relief without what is below two per cent of the top."""
    cells = relief(spark, d)
    top = cells.agg(F.max("v").alias("top"))
    return cells.crossJoin(F.broadcast(top)).where("v >= 0.02 * top").select("cx", "cy", F.round("v", 4).alias("v"))


_slope = "(coalesce((SELECT v FROM v n WHERE n.cx = v.cx + {0} AND n.cy = v.cy + {1}), 0) - coalesce((SELECT v FROM v n WHERE n.cx = v.cx - {0} AND n.cy = v.cy - {1}), 0)) / 400"


@query("relief_gradient", sql(f"WITH {_relief} SELECT cx, cy, round({_slope.format(1, 0)}, 6) AS gx, round({_slope.format(0, 1)}, 6) AS gy FROM v"))
def relief_gradient(spark, d):
    """Central differences of the relief, which is 0 where it has no cell. Each cell tells its neighbours its height, so the cells are joined with nothing."""
    told = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    heard = relief(spark, d).withColumn("k", F.explode(told)).select((F.col("cx") + F.col("k.x")).alias("cx"), (F.col("cy") + F.col("k.y")).alias("cy"), "k", "v")
    # a cell hears from its right neighbour, which tells its left one
    of = lambda x, y: F.coalesce(F.sum(F.when((F.col("k.x") == x) & (F.col("k.y") == y), F.col("v"))), F.lit(0.0))
    cells = heard.groupBy("cx", "cy").agg(F.count_if((F.col("k.x") == 0) & (F.col("k.y") == 0)).alias("own"), ((of(-1, 0) - of(1, 0)) / (2 * CELL)).alias("gx"), ((of(0, -1) - of(0, 1)) / (2 * CELL)).alias("gy"))
    return cells.where("own > 0").select("cx", "cy", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"))


@query("stream_day_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_day_counts(spark, d):
    """Extension: the day counts of the events as a stream, run to its end."""
    from citadine.streaming.counts import run_to_end

    return run_to_end(spark, f"{d}/events.parquet")
