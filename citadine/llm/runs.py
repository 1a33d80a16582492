"""Operator 2: line deduplication over levelled sorted runs of line hashes.

A line's key is the line with white space stripped at both ends and A-Z lower-cased. The store holds sorted runs of (key hash, documents, largest doc_id),
as tables bucketed and sorted by the hash, so that joins with them merge without a shuffle. Batches of documents are added by descending doc_id. A new batch is
merge-joined with all runs: a key that none of them has (the anti-join) brings the largest doc_id that holds it, and no later batch writes another; a known key
only adds to the count, and one that is already found often enough adds nothing, so a line of every document costs the store a row for a few batches at most. The
batch's rows form a new run of the lowest level; ``fanout`` runs of a level are compacted into one of the next. Keys found often
enough at last lose their lines in all documents but the largest.

Everything is DataFrame operations. A key is counted before it is shuffled, so a line that a third of all documents hold is a few
rows; per document only the hashes of its own dropped lines are gathered. There are ``BATCHES`` batches, or more if one would give a partition over
``BATCH_KEYS`` keys.

Null and empty texts are one empty line. Each row is a document; rows that repeat the largest doc_id all keep the line, and a null doc_id is
smaller than any other. Extra columns, whatever their names, are ignored by op2 and kept by without_repeated_lines. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citadine.llm import scratch

KEY = ["h1", "h2"]
BATCHES, BATCH_KEYS = 4, 1 << 21
SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.btrim(F.translate(line, ascii_uppercase, ascii_lowercase), F.lit(SPACES))


def hash_of(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per document and distinct long key: doc_id, h1, h2."""
    keys = F.filter(F.transform(lines_of(F.col("text")), key_of), lambda k: F.length(k) >= min_chars)
    return docs.select("doc_id", F.explode(F.array_distinct(F.transform(keys, hash_of))).alias("k")).select("doc_id", "k.h1", "k.h2")


class Runs:
    """The store: levels of runs, each bucketed and sorted by key. ``enough`` documents settle a key."""

    def __init__(self, fanout: int = 3, enough: int = 5, buckets: int = 8):
        self.fanout, self.enough, self.buckets, self.levels = fanout, enough, buckets, [[]]

    def runs(self) -> list[DataFrame]:
        return [x for level in self.levels for x in level]

    def add(self, batch: DataFrame) -> None:
        """A batch with one row for each key: h1, h2, n, top, bucketed as the runs are; its doc_ids are not above those of earlier batches."""
        held = F.lit(0).cast("long")
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select(*KEY, F.col("n").alias(f"n{i}")).hint("merge"), KEY, "left")
            held = held + F.coalesce(f"n{i}", F.lit(0))
        own = batch.where(held < self.enough).select(*KEY, "n", F.when(held == 0, F.col("top")).alias("top"))
        self._put(0, run_of(own, "run0", self.buckets))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, run_of(merged(old).repartition(self.buckets, *KEY), f"run{level + 1}", self.buckets))
            scratch.drop(*old)

    def settled(self) -> DataFrame:
        """h1, h2 and top of the keys found in ``enough`` documents."""
        return merged(self.runs()).where(F.col("n") >= self.enough).select(*KEY, "top")


def run_of(rows: DataFrame, name: str, buckets: int, first: tuple[str, ...] = ()) -> DataFrame:
    """A table in the shared folder, bucketed by key and sorted by the columns ``first``, then by key; rows come dealt by key into so many partitions, so a bucket is one file."""
    spark, table = rows.sparkSession, f"citadine_{name}_{uuid.uuid4().hex}"
    at = scratch.path(spark, name)
    writer = rows.write.format("parquet").option("path", at).option("compression", "zstd")
    writer.bucketBy(buckets, *KEY).sortBy(*first, *KEY).saveAsTable(table)
    return scratch.owned(spark.table(table), at, table)


def merged(runs: list[DataFrame]) -> DataFrame:
    """One row per key: all its documents, and the one doc_id that the batch which brought it wrote.

    The runs' files are read as plain ones: Spark 4.1 may take a union of bucketed tables for one dealt by key when it is not, and leave out the exchange."""
    out = runs[0].sparkSession.read.schema(runs[0].schema).parquet(*[x._scratch[0] for x in runs])
    return out.groupBy(*KEY).agg(F.sum("n").alias("n"), F.first("top", ignorenulls=True).alias("top"))


def repeated_lines(lines: DataFrame, min_docs: int = 5, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """h1, h2 and top (the largest doc_id that holds it) of every key found in ``min_docs`` documents; ``lines`` has a row for each document and key."""
    buckets = scratch.partitions(lines.sparkSession)
    batches = batches or max(BATCHES, -(-lines.count() // (buckets * BATCH_KEYS)))
    cuts = sorted({int(x) for x in lines.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.1 / batches)}, reverse=True)
    batch = F.lit(len(cuts))
    for k, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > cut, k).otherwise(batch)
    counted = lines.groupBy(batch.alias("batch"), *KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    # All batches of a bucket are one file: on a local disk without its native library Hadoop starts a chmod for each new folder and two for each new file.
    deltas = run_of(counted.repartition(buckets, *KEY), "batches", buckets, ("batch",))
    store = Runs(fanout, min_docs, buckets)
    for k in range(len(cuts) + 1):
        store.add(deltas.where(F.col("batch") == k).drop("batch"))
    out = scratch.table(store.settled(), "repeated-lines")
    scratch.drop(deltas, *store.runs())
    return out


def deduplicated(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """row (of ``docs``) and gone: hashes of the lines that it loses, null for none."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lines = scratch.table(line_hashes(docs.select("doc_id", "text"), min_chars), "lines")
    drops = repeated_lines(lines, min_docs)
    found = lines.join(drops, KEY).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("h1").alias("gone"))
    return rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("id")), "left").select("row", "gone")


def kept_lines(text: Column, gone: Column, min_chars: int = 40) -> Column:
    """The lines that stay."""
    return F.filter(lines_of(text), lambda line: (F.length(key_of(line)) < min_chars) | ~F.array_contains(gone, F.xxhash64(key_of(line))))


def op2(docs: DataFrame) -> DataFrame:
    out = deduplicated(docs.select("doc_id", "text"))
    text = F.coalesce("row.text", F.lit(""))
    feeds = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit("\n"), F.lit("")))
    out = out.select("row.doc_id", (feeds(text) + 1).cast("long").alias("n_lines"), text.alias("text"), F.when(F.col("gone").isNotNull(), kept_lines(F.col("row.text"), F.col("gone"))).alias("kept"))
    n_kept = F.when(F.col("kept").isNull(), F.col("n_lines")).otherwise(F.size("kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - n_kept).cast("long").alias("n_dropped"), F.sha2(F.coalesce(F.array_join("kept", "\n"), "text"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with the lines that stay as their text, and n_chars of that; other columns as they were."""
    out = deduplicated(docs)
    text = F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept_lines(F.col("row.text"), F.col("gone")), "\n"))
    fields = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return out.select([fields.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, trim(translate(line, '{ascii_uppercase}', '{ascii_lowercase}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, g.top IS NOT NULL AND g.top <> k.doc_id AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
