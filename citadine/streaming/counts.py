"""Counts per day and kind of a stream of events, each event once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citadine import storage


def day_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events with a watermark, without repeats, counted in windows of a day."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))


def run_to_end(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder or a file as one stream, until it is read; the result is the final state of the counts.

    The sink is a memory table of one row per day and kind; a service would write each update with foreachBatch instead."""
    base = storage.folder(spark)
    schema = spark.read.parquet(path).schema
    glob = path if not path.endswith(".parquet") else path.rsplit("/", 1)[0]
    name = path.rsplit("/", 1)[1]
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))
    table = f"days_{uuid.uuid4().hex}"
    query = day_counts(stream).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", f"{base}/{table}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(table).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
