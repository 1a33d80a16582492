"""Tables kept in the folder that driver and executors share, written once and read by all that need them.

The folder is the session's ``spark.checkpoint.dir``; where that is unset a session on this machine alone takes one below the system's temp folder, and one on a cluster is refused.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 2  # of what is computed; a higher one leaves the tables of the lower ones alone


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/citadine-tables"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, so that what follows neither computes it twice nor keeps its lineage."""
    at = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def fingerprint(df: DataFrame) -> str:
    """Of a table's rows in any order: their number, and two sums and an exclusive or of their hashes."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    h = F.xxhash64(own)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h % (1 << 30)).alias("a"), F.sum(F.hash(own).cast("long")).alias("b")).first()
    return hashlib.sha256(repr((sorted(df.dtypes), tuple(r))).encode()).hexdigest()[:24]


def cached(spark: SparkSession, name: str, parameters: dict, inputs: list[DataFrame], build: Callable[[], DataFrame], sort: list[str] | None = None) -> DataFrame:
    """The table of this name, parameters and input rows if it is there, else built and written. A changed input or parameter is another table, so none is ever stale.

    Writers that race each write their own folder; the one whose folder gets the final name first is read by all."""
    key = hashlib.sha256(json.dumps([VERSION, parameters, [fingerprint(x) for x in inputs]], sort_keys=True, default=str).encode()).hexdigest()[:24]
    at = f"{folder(spark)}/{name}-{key}"
    try:
        return spark.read.parquet(at)
    except AnalysisException:
        pass
    part = f"{at}.{uuid.uuid4().hex}"
    df = build()
    (df.repartition(*sort).sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(at)) and files.rename(path(part), path(at)):
        return spark.read.parquet(at)
    return spark.read.parquet(at if files.exists(path(f"{at}/_SUCCESS")) else part)
