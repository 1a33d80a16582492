"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a session on this machine alone (local masters, as in tests) takes a folder
below the system's temp folder; on a cluster, whose executors would not see it, that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes: list[list[DataFrame]] = []


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/citadine-scratch"


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it read again, without its lineage."""
    at = path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(at)
    return owned(df.sparkSession.read.schema(df.schema).parquet(at), at)


def owned(df: DataFrame, at: str, name: str | None = None) -> DataFrame:
    """``df`` as a table of this module: its files, and its entry in the catalog if it has one, go with drop and with the scope it was made in."""
    df._scratch = (at, name)
    if _scopes:
        _scopes[-1].append(df)
    return df


def drop(*frames: DataFrame) -> None:
    """Delete the files behind tables that nothing reads any more."""
    for df in frames:
        at, name = getattr(df, "_scratch", (None, None))
        if at is None:
            continue
        spark = df.sparkSession
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        files = spark._jvm.org.apache.hadoop.fs.Path(at)
        files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)
        df._scratch = (None, None)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Tables made within are dropped at its end, but for those that the caller takes out of the list."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        drop(*made)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """The bytes of all texts, counted; numbers of groups follow from it."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
