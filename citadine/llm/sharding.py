"""Operator 7: sharding by vector bin packing.

Groups of equal texts stay together. Bytes, tokens and rows are balanced jointly, with bytes near equal as the law: units are placed
in order of their largest share, each in the shard where the dot product of its vector with the residual capacities is highest, among the
shards with room for its bytes. A unit is a group that holds over 1 / ``buckets`` of any of the three sums, or else a hash
bucket of the other groups, so there are at most four times ``buckets`` units whatever the number of documents, and only their
sums come to the driver. A group larger than a shard's capacity is split by doc_id into units that fit.

Slots are numbered by slices: rows of a unit are dealt into slices of bounded size, slices of a shard follow one another, and
a window numbers the rows of one slice.

Null texts have size 1, crc32 0 and no tokens. Rows with null or repeated doc_id get slots each; those without one are dealt by their place in the written table. Extra columns are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine.llm import scratch
from citadine.llm.mixing import WORD

DIMENSIONS = ("size", "tokens", "rows")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit; ``vectors`` has one row per unit with its bytes, tokens and rows."""
    total = np.maximum(vectors.sum(0), 1)
    shares = vectors / total * shards  # a shard's capacity is 1 in each dimension
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for k in np.lexsort((np.arange(len(shares)), -shares[:, 0], -shares.max(1))) if len(shares) else ():
        fits = residual[:, 0] >= shares[k, 0]
        score = np.where(fits, residual @ shares[k], -np.inf) if fits.any() else residual[:, 0]
        out[k] = int(np.argmax(score))
        residual[out[k]] -= shares[k]
    return out


def sharded(docs: DataFrame, shards: int = 8, buckets: int = 4096, slice_rows: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = scratch.table(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("crc"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.xxhash64("text").alias("h"),
            F.coalesce("doc_id", F.monotonically_increasing_id()).alias("salt"),
        ).select("doc_id", "size", F.coalesce("crc", F.lit(0)).cast("long").alias("text_crc32"), "tokens", "h", "salt"),
        "shard-rows",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    large = " or ".join(f"{d} > {(total[d] or 0) / buckets}" for d in DIMENSIONS)
    capacity = (total["size"] or 0) / shards
    split = F.when(F.col("size") > capacity, F.ceil(F.col("size") / max(capacity, 1) * 8)).otherwise(1).cast("long")
    groups = scratch.table(rows.groupBy("h").agg(*sums).where(large).select(F.col("h").alias("__h"), split.alias("parts")), "shard-groups")  # at most three times buckets rows
    placed = rows.join(F.broadcast(groups), F.col("h") == F.col("__h"), "left")
    part = F.when(F.col("__h").isNull(), F.pmod("h", F.lit(buckets))).otherwise(F.pmod(F.xxhash64(F.lit(3), "salt"), F.col("parts")))
    placed = placed.select("doc_id", "size", "text_crc32", "tokens", "salt", "__h", part.alias("part"))
    units = placed.groupBy("__h", "part").agg(*sums).collect()
    units.sort(key=lambda u: (u["__h"] is not None, u["__h"] or 0, u["part"]))
    shard = place(np.array([[u[d] for d in DIMENSIONS] for u in units], float).reshape(-1, 3), shards)
    per_slice = max(slice_rows, math.ceil((total["rows"] or 0) / 100_000))
    table = [(u["__h"], u["part"], k, int(s), -(-u["rows"] // per_slice)) for k, (u, s) in enumerate(zip(units, shard, strict=True))]
    known = spark.createDataFrame(table, "h2 long, part2 long, unit long, shard int, slices long")
    out = placed.join(F.broadcast(known), F.col("__h").eqNullSafe(F.col("h2")) & (F.col("part") == F.col("part2")))
    out = out.withColumn("slice", F.pmod(F.xxhash64(F.lit(5), "salt"), F.col("slices"))).select("doc_id", "size", "text_crc32", "salt", "shard", "unit", "slice")
    slices = out.groupBy("shard", "unit", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("unit", "slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "shard")
    within = Window.partitionBy("unit", "slice").orderBy("salt", "doc_id", "text_crc32")
    out = out.withColumn("number", F.row_number().over(within) - 1).join(slices, ["unit", "slice"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("number")).cast("long").alias("slot"))


def op7(docs: DataFrame) -> DataFrame:
    out = sharded(docs.select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
