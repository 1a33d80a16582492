"""Operator 5: mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Each source has a weight and a target (its share of the mix, at most ``repeats`` times its size).
The unit of the mix, its block, is one word at every input size. Sainte-Laguë gives words to sources by highest quotients of their targets, and within
a source to its shards by those of their words, so that every shard has a whole number of words to give. A shard holds documents by
their hash, in seeded order. Its quota takes all of them as often as it holds the whole shard; what is left takes documents from the start of that order,
whole ones up to the document at the quota's edge, of which it takes the first words. So each shard cuts at most one document.

A large source has many shards, none of which holds much more than ``shard_tokens``; apportionment sees one row per source and per
shard only.

Null and empty texts have no words and take none. Null is a source of its own, last. Rows with null or repeated doc_id
are taken each by itself, in an order by doc_id and text. Extra columns are ignored by op5. Empty tables give empty results. The same rows and seed give the same mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
WEIGHTS = (5, 2, 1)


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 * seats so far + 1), none above its cap; equal quotients go to the earlier entry.

    The divisor that gives at most ``seats`` by rounding is found by bisection, and what is then left goes out one by one.
    """
    votes, caps = np.asarray(votes, float), np.where(np.asarray(votes) > 0, np.asarray(caps, np.int64), 0)
    seats = min(int(seats), int(caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), caps).astype(np.int64)
    high, low = 2 * votes.max() + 1, votes[votes > 0].min() / (2 * seats + 3)
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    out = given(high)
    while (left := seats - int(out.sum())) > 0:
        quotients = np.where(out < caps, votes / (2 * out + 1), -1.0)
        best = np.lexsort((np.arange(len(votes)), -quotients))[: max(1, min(left, int((quotients == quotients.max()).sum())))]
        out[best] += 1
    return out


def sized(docs: DataFrame) -> DataFrame:
    """__s is the source as a key that is never null and sorts nulls last; h tells texts apart."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", size.alias("size"), F.xxhash64("text").alias("h"), F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("__s"))


def targets(sizes: DataFrame, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source: __s, source_size, target.

    Filling by weight up to the caps stops each source in the order of cap / weight; what the others get per unit of weight follows
    from the first source in that order that stays below its cap. The windows see one row per source.
    """
    rows = sizes.groupBy("__s").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(Window.orderBy("__s")) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(repeats))
    order = Window.orderBy(F.col("cap") / F.col("w"), "__s")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    rate = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("rate", rate)
    free = F.min(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("__s"), F.col("rate")))).over(Window.partitionBy())
    rate = free.getField("rate")
    return rows.withColumn("rate", rate).select("__s", "source_size", F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("rate") * F.col("w"))).alias("target"))


def _quotas(repeats: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Words that each shard of one source gives."""
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        n = pdf["tokens"].to_numpy()
        return pd.DataFrame({"__s": pdf["__s"], "shard": pdf["shard"], "n": n, "quota": sainte_lague(n, int(pdf["words"].iloc[0]), repeats * n)})

    return run


def _of_sources(pdf: pd.DataFrame) -> pd.DataFrame:
    """Words of each source; one row per source comes in."""
    pdf = pdf.sort_values("__s").reset_index(drop=True)
    pdf["words"] = sainte_lague(pdf["target"].to_numpy(), int(pdf["seats"].iloc[0]), pdf["most"].to_numpy())
    return pdf[["__s", "source_size", "target", "shards", "words"]]


def plan(docs: DataFrame, share: float = 1.5, repeats: int = 2, shard_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """The documents with how often the mix takes them whole (full), and how many of their first words it takes once more (part)."""
    sizes = scratch.table(sized(docs), "mix-sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sources = targets(sizes, share, repeats).withColumns(
        {
            "seats": F.lit(round(total * share)).cast("long"),
            "most": (F.col("source_size") * repeats).cast("long"),
            "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long"),
        }
    )
    sources = scratch.table(sources.groupBy(F.lit(1).alias("__g")).applyInPandas(_of_sources, "__s string, source_size long, target double, shards long, words long"), "mix-sources")
    placed = sizes.join(sources, "__s").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.col("shards")))
    shards = placed.groupBy("__s", "shard", "words").agg(F.sum("size").alias("tokens"))
    quotas = shards.groupBy("__s").applyInPandas(_quotas(repeats), "__s string, shard long, n long, quota long")
    order = Window.partitionBy("__s", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "h"), "doc_id", "size", "h")
    stream = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(quotas, ["__s", "shard"])
    words = lambda x: F.when(F.col("size") > 0, x).otherwise(0).cast("long")
    rest = F.col("quota") % F.col("n") - (F.col("end") - F.col("size"))
    return stream.select("doc_id", "size", "h", "__s", "source_size", "target", words(F.floor(F.col("quota") / F.col("n"))).alias("full"), words(F.greatest(F.lit(0), F.least("size", rest))).alias("part"))


def op5(docs: DataFrame) -> DataFrame:
    rows = plan(docs.select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: a row for each time that a document is taken. Its text is as it was, but for the document at the edge of a shard's quota, whose
    last row ends with the last word taken.

    A row is joined with its place by doc_id, source and a hash of its text; rows that repeat all three are taken as often as the first of them. n_chars follows the text.
    """
    columns = docs.columns
    rows = plan(docs.select("doc_id", "text", "source")).groupBy("doc_id", "h", "__s").agg(F.first("full").alias("full"), F.first("part").alias("part"), F.first("size").alias("size"))
    rows = rows.where("size > 0 and full + part > 0")
    source = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col("doc_id").alias("__doc"), source.alias("__source"), F.xxhash64("text").alias("__h"))
    own = F.col("__doc").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("h")) & (F.col("__source") == F.col("__s"))
    turns = F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0)
    turned = named.join(rows, own).select("__row", "size", "full", "part", F.explode(F.sequence(F.lit(1).cast("long"), turns)).alias("__turn"))
    cut = (F.col("__turn") > F.col("full")) & (F.col("part") < F.col("size"))
    text = F.col("__row").getField("text")
    head = F.array_join(F.slice(F.split(text, WORD_END, F.col("part").cast("int") + 1), F.lit(1), F.col("part").cast("int")), "")
    fields = {"text": F.when(cut, head).otherwise(text)} | ({"n_chars": F.length(F.when(cut, head).otherwise(text)).cast("long")} if "n_chars" in columns else {})
    return turned.select([fields.get(c, F.col("__row").getField(c)).alias(c) for c in columns])
