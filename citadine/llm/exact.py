"""Operator 3: exact deduplication with counting quotient filters.

Every text has a fingerprint of ``BITS`` bits. Each task fills a counting quotient filter (see quotient.py) with those of its rows, and gives it away in slabs, by
the first bits; slabs of the same bits merge by their sorted remainders, without loss and whatever the order. Fingerprints that count more than one are routed to
byte verification, where whole normalised texts are grouped; a fingerprint that counts one is of a text that no other equals, so it stays at once.

Routed texts are chosen at the scan by a bitmap of ``MARKS`` bits of the routed fingerprints, so its size is the same for any corpus. A text that it lets through by chance, and texts
that share a fingerprint by chance, part in the verification; a bitmap filled up by a vast corpus only saves less. A group of copies is one entry per
task in the filters, and is summed within each task before texts are shuffled by content, so it may hold any share of all rows.

Null counts as empty, and empty texts are equal. Rows that repeat both the text and the largest doc_id all count as the one that stays; a null doc_id is
smaller than any other. Extra columns are ignored by op3. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadine.llm import quotient, scratch

BITS = 48
MARKS = 24
SLAB = "slab int, quotient_bits int, size int, occupied binary, run_ends binary, remainders binary, repeated binary, counters binary"
FIELDS = [x.split()[0] for x in SLAB.split(", ")]
FLUSH = 1 << 20  # fingerprints that a task holds before it gives its filter away


def _filters(bits: int, slab_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[quotient.Filter] = []

        def slabs() -> pa.RecordBatch:
            parts = quotient.merged(held).parts(slab_bits)
            columns = [[slab for slab, _ in parts], *([getattr(f, name) for _, f in parts] for name in FIELDS[1:])]
            kinds = [pa.int32()] * 3 + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=FIELDS)

        for batch in batches:
            if len(batch):
                held.append(quotient.filled(batch.column(0).to_numpy().view("uint64"), bits))
            if sum(f.size for f in held) > FLUSH:
                yield slabs()
                held.clear()
        if held:
            yield slabs()

    return run


def _merge(bits: int, slab_bits: int):
    def run(slabs: pa.Table) -> pa.Table:
        """Fingerprints of one slab that are counted more than once in all filters together."""
        rows = slabs.to_pylist()
        whole = quotient.merged([quotient.Filter(bits - slab_bits, *(r[name] for name in FIELDS[1:])) for r in rows])
        keys, counts = whole.entries()
        again = counts > 1
        fp = keys[again] | quotient.U64(rows[0]["slab"] << (bits - slab_bits))
        return pa.table({"fp": pa.array(fp.view("int64")), "n": pa.array(counts[again])})

    return run


def repeated_fingerprints(fingerprints: DataFrame, column: str = "fp", bits: int = BITS) -> DataFrame:
    """fp and n of every fingerprint (a long of ``bits`` bits) found more than once."""
    slab_bits = min(bits, max(2, (2 * scratch.partitions(fingerprints.sparkSession) - 1).bit_length()))
    slabs = fingerprints.select(column).mapInArrow(_filters(bits, slab_bits), SLAB)
    return slabs.groupBy("slab").applyInArrow(_merge(bits, slab_bits), "fp long, n long")


def marks(fingerprints: DataFrame, bits: int = BITS, marks: int = MARKS) -> DataFrame:
    """A bitmap by the first bits of the fingerprints, as words of 64 bits: at most 2 ** (marks - 6) rows word, mask."""
    place = F.shiftrightunsigned("fp", bits - marks)
    return fingerprints.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("mask"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, keep_id and group_size of every row."""
    norm = F.translate(F.coalesce(F.col("text"), F.lit("")), ascii_uppercase, ascii_lowercase)
    texts = docs.select("doc_id", norm.alias("norm")).withColumn("fp", F.shiftrightunsigned(F.xxhash64("norm"), 64 - BITS))
    ids = scratch.table(texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")), "fingerprints")
    marked = marks(repeated_fingerprints(ids))
    place = F.shiftrightunsigned("fp", BITS - MARKS)
    routed = texts.withColumn("word", F.shiftrightunsigned(place, 6)).join(F.broadcast(marked), "word").where(F.getbit("mask", (place % 64).cast("int")) == 1)
    verified = (
        routed.groupBy("fp", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    out = ids.join(verified, ["fp", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")


def op3(docs: DataFrame) -> DataFrame:
    out = groups(docs.select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
