"""Ingestion on dirty rows made from orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from citadine.functions import parsing
from citadine.operators import ingest
from citadine.plans.registry import query
from citadine.plans.surrogate import incidents, table

RAW_SQL = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 97 = 0 THEN 'north' WHEN o_orderkey % 89 = 0 THEN '95.5' WHEN o_orderkey % 83 = 0 THEN 'NaN' ELSE CAST(-12 - (o_orderkey % 100) AS VARCHAR) END AS lat,
  CASE WHEN o_orderkey % 79 = 0 THEN '181' WHEN o_orderkey % 73 = 0 THEN '' ELSE CAST(-77 + (o_orderkey % 50) AS VARCHAR) END AS lon,
  CASE WHEN o_orderkey % 71 = 0 THEN 'yesterday' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS fecha,
  CASE WHEN o_orderkey % 67 = 0 THEN '   ' ELSE o_orderstatus END AS crimen,
  CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderpriority END AS tipo,
  strftime(o_orderdate, '%Y-%m') AS mes, o_custkey % 40 AS district
FROM orders"""
REASON_SQL = """CASE WHEN NOT coalesce(TRY_CAST(lat AS DOUBLE) BETWEEN -90 AND 90 AND NOT isnan(TRY_CAST(lat AS DOUBLE)), false) THEN 'lat'
  WHEN NOT coalesce(TRY_CAST(lon AS DOUBLE) BETWEEN -180 AND 180, false) THEN 'lon'
  WHEN try_strptime(fecha, '%Y-%m-%d %H:%M:%S') IS NULL THEN 'fecha' WHEN trim(coalesce(crimen, '')) = '' THEN 'crimen' WHEN trim(coalesce(tipo, '')) = '' THEN 'tipo' END"""


def raw(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"),
        F.when(k % 97 == 0, "north").when(k % 89 == 0, "95.5").when(k % 83 == 0, "NaN").otherwise((-12 - k % 100).cast("string")).alias("lat"),
        F.when(k % 79 == 0, "181").when(k % 73 == 0, "").otherwise((-77 + k % 50).cast("string")).alias("lon"),
        F.when(k % 71 == 0, "yesterday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("fecha"),
        F.when(k % 67 == 0, "   ").otherwise(F.col("o_orderstatus")).alias("crimen"),
        F.when(k % 61 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("tipo"),
        F.date_format("o_orderdate", "yyyy-MM").alias("mes"),
        (F.col("o_custkey") % 40).alias("district"),
    )


def reasoned(spark, d):
    return raw(spark, d).withColumn("reason", parsing.invalid_reason(*[F.col(c) for c in ("lat", "lon", "fecha", "crimen", "tipo")]))


@query("validate_rows", f"SELECT coalesce({REASON_SQL}, 'valid') AS reason, count(*) AS n FROM ({RAW_SQL}) GROUP BY ALL")
def validate_rows(spark, d):
    return reasoned(spark, d).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "validation_report",
    f"""WITH r AS (SELECT *, {REASON_SQL} AS reason, upper(trim(coalesce(crimen, ''))) = 'P' AS ex, row_number() OVER (PARTITION BY district, mes, tipo, crimen ORDER BY id) > 1 AS dup,
    NOT (mes BETWEEN '1996-01' AND '1998-12') AS outside FROM ({RAW_SQL}))
    SELECT count(*) AS total_rows, count(*) FILTER (reason IS NULL) AS valid_rows, count(*) FILTER (reason IS NOT NULL) AS discarded_rows, count(*) FILTER (reason IS NULL AND ex) AS excluded_rows,
    count(*) FILTER (reason IS NULL AND NOT ex AND dup) AS duplicate_rows, count(*) FILTER (reason IS NULL AND NOT ex AND NOT dup AND outside) AS filtered_rows,
    count(*) FILTER (reason IS NULL AND NOT ex AND NOT dup AND NOT outside) AS kept_rows FROM r""",
)
def validation_report(spark, d):
    from pyspark.sql.window import Window

    rows = reasoned(spark, d).withColumns(
        {
            "ex": ingest.excluded({"crimen": F.col("crimen")}, {"crimen": ["p"]}, {}),
            "dup": F.row_number().over(Window.partitionBy("district", "mes", "tipo", "crimen").orderBy("id")) > 1,
            "outside": ~ingest.in_months(F.col("mes"), "1996-01", "1998-12"),
        }
    )
    return ingest.report(rows, "reason", "dup", "ex", "outside")


LAYOUTS_SQL = ("%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y", "%Y-%m-%d")
SPARK_LAYOUTS = ("MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyy-MM-dd")
_cases = " ".join(f"WHEN {k} THEN strftime(t, '{p}')" for k, p in enumerate(LAYOUTS_SQL))
_tries = ", ".join(f"try_strptime(raw, '{p}')" for p in LAYOUTS_SQL)


@query("parse_dates", f"WITH s AS (SELECT event_id, ts + to_hours(CAST(event_id % 14 AS INTEGER)) AS t FROM events), r AS (SELECT event_id, CASE event_id % 10 {_cases} END AS raw FROM s) SELECT event_id, raw, strftime(coalesce({_tries}), '%Y-%m-%d %H:%M:%S') AS parsed FROM r")
def parse_dates(spark, d):
    t = F.col("ts") + F.make_interval(hours=F.col("event_id") % 14)
    raw_date = F.lit(None).cast("string")
    for k, p in enumerate(SPARK_LAYOUTS):
        raw_date = F.when(F.col("event_id") % 10 == k, F.date_format(t, p)).otherwise(raw_date)
    out = table(spark, d, "events").select("event_id", raw_date.alias("raw"))
    return out.withColumn("parsed", F.date_format(parsing.parsed_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss"))


@query("parse_zoned_dates", "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m') AS mes, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def parse_zoned_dates(spark, d):
    raw_date = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    local = parsing.parsed_date(raw_date, -5)
    return table(spark, d, "events").select("event_id", F.date_format(local, "yyyy-MM").alias("mes"), F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local"))


@query("month_of", "SELECT strftime(o_orderdate, '%Y-%m') AS mes, count(*) AS n FROM orders GROUP BY ALL")
def month_of(spark, d):
    return incidents(spark, d).groupBy("mes").agg(F.count("*").alias("n"))


@query("scope_filter", "SELECT count(*) AS total, count(*) FILTER (upper(trim(o_orderpriority)) IN ('1-URGENT', '2-HIGH')) AS kept FROM orders")
def scope_filter(spark, d):
    return incidents(spark, d).agg(F.count("*").alias("total"), F.count_if(ingest.in_categories(F.col("tipo"), ["1-urgent ", "2-High"])).alias("kept"))


@query("window_filter", "SELECT strftime(o_orderdate, '%Y-%m') AS mes, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1997-03' AND '1998-02' GROUP BY ALL")
def window_filter(spark, d):
    return incidents(spark, d).where(ingest.in_months(F.col("mes"), "1997-03", "1998-02")).groupBy("mes").agg(F.count("*").alias("n"))


@query("source_exclude", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE NOT upper(trim(l_returnflag)) IN ('R') AND upper(trim(l_linestatus)) IN ('O', 'F') GROUP BY ALL")
def source_exclude(spark, d):
    reject = ingest.excluded({"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")}, {"flag": ["r "]}, {"status": ["o", "f"]})
    return table(spark, d, "lineitem").where(~reject).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


@query("dedupe_id", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ORDER)}) = 1")
def dedupe_id(spark, d):
    return ingest.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("dedupe_content", "SELECT min(doc_id) AS doc_id, md5(text) AS content FROM documents GROUP BY text")
def dedupe_content(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("content"))
    return ingest.keep_first(docs, ["content"], ["doc_id"])


@query("dedupe_null_ids", "SELECT min(id) AS id, tipo FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS tipo FROM orders) GROUP BY tipo")
def dedupe_null_ids(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("tipo"))
    return ingest.keep_first(rows, ["tipo"], ["id"])


@query("fallback_points", "SELECT l_suppkey, l_linenumber, count(*) AS n_rows, count(DISTINCT CAST(l_partkey AS VARCHAR)) AS n_addresses FROM lineitem GROUP BY ALL HAVING count(*) >= 30 AND count(DISTINCT l_partkey) >= 20")
def fallback_points(spark, d):
    rows = table(spark, d, "lineitem").withColumn("address", F.col("l_partkey").cast("string"))
    return ingest.fallback_points(rows, ["l_suppkey", "l_linenumber"], "address", 30, 20)


@query(
    "without_fallback_points",
    "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE (l_suppkey, l_linenumber) NOT IN (SELECT (l_suppkey, l_linenumber) FROM lineitem GROUP BY l_suppkey, l_linenumber HAVING count(*) >= 88 AND count(DISTINCT l_partkey) >= 20) GROUP BY ALL",
)
def without_fallback_points(spark, d):
    rows = table(spark, d, "lineitem").withColumn("address", F.col("l_partkey").cast("string"))
    flagged = ingest.fallback_points(rows, ["l_suppkey", "l_linenumber"], "address", 88, 20)
    return rows.join(flagged, ["l_suppkey", "l_linenumber"], "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "normalize_address",
    "SELECT page_id, trim(regexp_replace(strip_accents(lower(url)), '[^a-z0-9]+', ' ', 'g')) AS address FROM pages "
    "UNION ALL SELECT -1 - doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) FROM documents",
)
def normalize_address(spark, d):
    a = table(spark, d, "pages").select("page_id", parsing.plain_address(F.col("url")).alias("address"))
    return a.unionByName(table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("page_id"), parsing.plain_address(F.col("text")).alias("address")))


@query("composite_uid", "SELECT trim(l_returnflag) || '|' || trim(l_linestatus) || '|' || CAST(l_linenumber AS VARCHAR) AS uid, count(*) AS n FROM lineitem GROUP BY ALL")
def composite_uid(spark, d):
    uid = parsing.composite_uid(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber"))
    return table(spark, d, "lineitem").groupBy(uid.alias("uid")).agg(F.count("*").alias("n"))


@query(
    "load_fingerprint",
    """WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT p, quantile_disc(o_orderkey, p) AS mark FROM orders, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS p) GROUP BY p),
    q AS (SELECT string_agg(o_orderkey || ':' || o_custkey || ':' || o_orderpriority, '|' ORDER BY p.p) AS probes FROM p JOIN orders ON o_orderkey = mark)
    SELECT substr(sha1(n || '|' || probes), 1, 16) AS fingerprint FROM n, q""".replace("quantile_disc(o_orderkey, p) AS mark FROM orders, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS p) GROUP BY p", "ls[i] AS mark FROM (SELECT quantile_disc(o_orderkey, [0.0, 0.25, 0.5, 0.75, 1.0]) AS ls FROM orders), (SELECT unnest([1, 2, 3, 4, 5]) AS i, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS p)"),
)
def load_fingerprint(spark, d):
    probe = F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority")
    return ingest.fingerprint(table(spark, d, "orders"), "o_orderkey", probe)


@query("bbox", "SELECT min(TRY_CAST(lat AS DOUBLE)) AS lat0, min(TRY_CAST(lon AS DOUBLE)) AS lon0, max(TRY_CAST(lat AS DOUBLE)) AS lat1, max(TRY_CAST(lon AS DOUBLE)) AS lon1 FROM (SELECT * FROM (" + RAW_SQL + f") WHERE ({REASON_SQL}) IS NULL)")
def bbox(spark, d):
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    return reasoned(spark, d).where("reason is null").agg(F.min(lat).alias("lat0"), F.min(lon).alias("lon0"), F.max(lat).alias("lat1"), F.max(lon).alias("lon1"))
