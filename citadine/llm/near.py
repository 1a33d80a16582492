"""Operator 6: documents whose word shingles have a Jaccard similarity of 0.8 or more, by a grouped prefix join.

1. All shingles are counted in a table of fixed size; its logarithmic classes order the shingles, rare ones first. The order only decides
   how much work there is: any order common to all documents gives the same links.
2. Documents with equal sets are one class, and classes with equal size and prefix one group. A document of n shingles has a prefix of its
   first p = n - ceil(0.8 n) + 1 + n // 20. Linked documents of n and m shingles have 4 (n + m) / 9 in common, and outside their prefixes no
   more than the larger of n - p(n) and m - p(m); so the rest must be among their prefixes. Pairs of groups that share fewer prefix shingles, or
   differ too much in size, are left out; so are groups that share too few with any other. The first shared shingle has all others that must be shared
   behind it, so pairs are looked for at early places only, and the prefixes of what is found are compared.
3. Pairs of groups are expanded to pairs of their classes, and the whole sets are intersected.

Large groups of near copies would have pairs without number, and most would tell nothing new. So pairs come in rounds. First each group offers
pairs of one class with its others, and each prefix shingle pairs of one holder with all others: of the one that shares most of its prefix, the likely centre of a group of copies, and then of a random
one; of a group's classes one speaks for each component. Their links are contracted to components; pairs within a component need no verification, since components are all that is asked for. At
last all pairs left between different components are verified, in groups and between them, whatever their number; so no link between components is lost.

Null, empty and blank texts have no shingles and are linked with nothing. A text of one to four words is one shingle. Each row is a
document; rows may share a doc_id; a null doc_id is never the smallest. Extra columns are ignored by op6 and kept by representatives.
Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadine.llm import located, scratch, words
from citadine.llm.components import components

WORDS = 5
BITS = 20
SKETCH_PARTS = 32
EXTRA = 20
SETS = "kind int, doc_id long, d long, t int, n int, c1 long, c2 long, sketch binary"
BUCKET_SHINGLES = 4_000_000  # of some 32 MB of text
ENTRIES = "kind int, token long, n int, g1 long, g2 int, c1 long, c2 long"
SALT = np.uint64(0xA24BAED4963EE407)


def shingles(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents of a piece, sorted within each document, and where each document's begin."""
    raw, offsets = words.text_bytes(piece.column("text"))
    raw = words.LOWER[raw]
    starts, ends, firsts = words.word_spans(raw, offsets)
    hashes, owner = words.span_hashes(raw, starts, ends), words.document_of(firsts)
    full = words.grams(hashes, WORDS)
    at = np.flatnonzero(owner[: len(full)] == owner[WORDS - 1 :]) if len(full) else np.zeros(0, np.int64)
    keys, docs = [full[at]], [owner[at]]
    sizes = np.diff(firsts)
    for k in range(1, WORDS):
        short = np.flatnonzero(sizes == k)
        if len(short):
            keys.append(words.mixed(words.grams(hashes, k)[firsts[short]] ^ np.uint64(k)))
            docs.append(short)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(key)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(sizes) < 1 << 16 else np.int64), kind="stable")]
    key, doc = key[order], doc[order]
    head = located.runs_of(key, doc)
    key, doc = key[head], doc[head]
    return key, np.searchsorted(doc, np.arange(len(sizes) + 1))


def summed(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def fingerprints(keys: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, whatever the order of its members."""
    return words.mixed(summed(words.mixed(keys), cuts)).view(np.int64), words.mixed(summed(words.mixed(keys ^ SALT), cuts)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BITS, np.int64)
    names = [x.split()[0] for x in SETS.split(", ")]
    for piece in words.pieces(batches):
        keys, cuts = shingles(piece)
        counts += np.bincount((keys >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        c1, c2 = fingerprints(keys, cuts)
        n = len(piece)
        columns = [pa.array(np.zeros(n, np.int32)), piece.column("doc_id"), piece.column("d"), piece.column("t"), pa.array(np.diff(cuts).astype(np.int32)), pa.array(c1), pa.array(c2), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    if counts.any():
        parts = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(counts, SKETCH_PARTS)]
        zero = pa.array(np.zeros(SKETCH_PARTS, np.int64))
        columns = [pa.array(np.ones(SKETCH_PARTS, np.int32)), zero, pa.array(np.arange(SKETCH_PARTS)), zero.cast(pa.int32()), zero.cast(pa.int32()), zero, zero, pa.array(parts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _sum_sketches(parts: pa.Table) -> pa.Table:
    total = np.zeros((1 << BITS) // SKETCH_PARTS, np.int64)
    for x in parts.column("sketch").to_pylist():
        total += np.frombuffer(zlib.decompress(x), np.uint32)
    return pa.table({"part": parts.column("d")[:1], "sketch": pa.array([total.tobytes()], pa.binary())})


def frequency_classes(sketch: np.ndarray) -> np.ndarray:
    """One byte per slot of the table, growing with the logarithm of its count."""
    return np.minimum(255, np.round(8 * np.log2(sketch + 1.0))).astype(np.uint8)


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - (4 * n + 4) // 5 + 1 + n // EXTRA)


def _prefixes(classes: np.ndarray, buckets: int):
    names = [x.split()[0] for x in located.DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = located.Dealer(buckets, lambda hi: (words.mixed(hi) % np.uint64(buckets)).astype(np.int64), limit=1_000_000, keep_keys=True)
        members = 0
        for piece in words.pieces(batches):
            keys, cuts = shingles(piece)
            n = np.diff(cuts)
            doc = np.repeat(np.arange(len(n)), n)
            rank = classes[(keys >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | keys >> np.uint64(8)
            order = np.argsort(rank, kind="stable")
            order = order[np.argsort(doc[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
            order = order[np.arange(len(order)) - cuts[:-1][doc] < prefix_lengths(n)[doc]]
            c1, c2 = fingerprints(keys, cuts)
            prefix, owner = keys[order], doc[order]
            own = np.searchsorted(owner, np.arange(len(n) + 1))
            g1, g2 = fingerprints(prefix, own)
            g1 = words.mixed(g1.view(np.uint64) ^ words.mixed(n.astype(np.uint64))).view(np.int64)
            g2 = (g2 & 0x7FFFFFFF).astype(np.int32)
            _, first_class = np.unique(np.stack([c1, c2], 1), axis=0, return_index=True)
            first_class = np.sort(first_class[n[first_class] > 0])
            if not len(first_class):
                continue
            row = [buckets + members % buckets, True, c1[first_class].tobytes() + c2[first_class].tobytes(), g1[first_class].tobytes(), b"members", g2[first_class].tobytes(), n[first_class].astype(np.int32).tobytes()]
            kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)
            members += 1
            _, first_group = np.unique(np.stack([g1, g2.astype(np.int64)], 1), axis=0, return_index=True)
            use = np.isin(owner, first_group)
            place = (np.arange(len(prefix)) - own[owner])[use]
            prefix, owner = prefix[use], owner[use]
            yield from dealer.add(prefix, np.zeros(len(prefix), np.uint32), g1[owner], g2[owner], place)
        yield from dealer.close()

    return run


def _entries(kind, token, n, g1, g2, c1, c2) -> pa.Table:
    size = len(g1)
    return pa.table(
        {
            "kind": pa.array(np.full(size, kind, np.int32)),
            "token": pa.array(token.view(np.int64)),
            "n": pa.array(n.astype(np.int32)),
            "g1": pa.array(g1),
            "g2": pa.array(g2),
            "c1": pa.array(c1),
            "c2": pa.array(c2),
        }
    )


def _shared_prefixes(dealt: pa.Table) -> pa.Table:
    """The prefix shingles of a bucket that several groups hold, with their groups and their place in the prefix (as n); and the members of groups."""
    outs, tokens, places, mark = [], [], [], []
    none = lambda n: np.zeros(n, np.int64)
    for row in dealt.to_pylist():
        if row["tags"] == b"members":
            c = np.frombuffer(row["keys"], np.int64).reshape(2, -1)
            outs.append(_entries(1, none(c.shape[1]), np.frombuffer(row["pos"], np.int32), np.frombuffer(row["docs"], np.int64), np.frombuffer(row["counts"], np.int32), c[0], c[1]))
            continue
        g1, g2, n = located.unpacked(row)
        size = len(row["keys"]) // 12
        keys = np.frombuffer(row["keys"], np.uint64, size)
        if row["settled"]:
            outs.append(_entries(0, keys, n, g1, g2, none(size), none(size)))
            continue
        tokens.append(keys)
        mark.append(np.arange(size) < len(g1))
        places.append((g1, g2, n))
    if tokens:
        key, here = np.concatenate(tokens), np.concatenate(mark)
        g1, g2, n = (np.concatenate(x) for x in zip(*places))
        again = (located.twice(key, np.zeros(len(key), np.uint32)) > 0)[here]
        key, g1, g2, n = key[here][again], g1[again], g2[again], n[again]
        order = np.lexsort((g2, g1, key))
        order = order[located.runs_of(key[order], g1[order], g2[order])]
        outs.append(_entries(0, key[order], n[order], g1[order], g2[order], none(len(order)), none(len(order))))
    return pa.concat_tables(outs)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in words.pieces(batches):
        keys, cuts = shingles(piece)
        yield pa.RecordBatch.from_arrays([piece.column("cid"), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(keys.view(np.int64)))], names=["cid", "items"])


def prefix_sql(n: str) -> str:
    return f"least({n}, {n} - (4 * {n} + 4) div 5 + 1 + {n} div {EXTRA})"


def fits(a: str, b: str) -> str:
    """Sizes of two sets that may be linked."""
    return f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})"


def enough(shared: str, rest: str, a: str, b: str) -> str:
    """Whether so many shared prefix shingles can be of linked sets of these sizes, of which ``rest`` shingles at most are outside the prefix: shared >= needed, without a division."""
    return f"9 * ({shared} + {rest}) + 8 >= 4 * ({a} + {b}) + 8"


def needed(a: str, b: str) -> str:
    """How many prefix shingles linked sets of these sizes share at least."""
    return f"greatest(1L, (4L * ({a} + {b}) + 8) div 9 - greatest({a} - {prefix_sql(a)}, {b} - {prefix_sql(b)}))"


def linked(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """doc_id, d, t (the row's key), n_shingles, cid (its class) and component (null without links)."""
    base = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.hash("text").alias("t"))
    sets = scratch.table(base.mapInArrow(_sets, SETS), "sets")
    rows = sets.where("kind = 0")
    sketch = np.zeros((SKETCH_PARTS, (1 << BITS) // SKETCH_PARTS), np.int64)
    for r in sets.where("kind = 1").groupBy("d").applyInArrow(_sum_sketches, "part long, sketch binary").collect():  # a table of fixed size
        sketch[r["part"]] = np.frombuffer(r["sketch"], np.int64)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(24, total // BUCKET_SHINGLES)
    dealt = base.select("text").mapInArrow(_prefixes(frequency_classes(sketch.ravel()), buckets), located.DEALT)
    entries = scratch.table(dealt.groupBy("bucket").applyInArrow(_shared_prefixes, ENTRIES), "prefixes")

    of_class = entries.where("kind = 1").select("c1", "c2", "g1", "g2", "n").distinct()
    firsts = rows.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct("d", "t")).alias("first"))
    ids = F.monotonically_increasing_id()
    classes = scratch.table(firsts.join(of_class, ["c1", "c2"]).select("c1", "c2", "g1", "g2", "n", "first.d", "first.t").withColumn("cid", ids), "classes")
    groups = scratch.table(classes.groupBy("g1", "g2", "n").agg(F.min("cid").alias("gid"), F.count("*").alias("members")), "groups")
    members = classes.join(groups.drop("n"), ["g1", "g2"]).select("cid", "gid", "n", "members", "d", "t")
    members = scratch.table(members, "members")
    held = entries.where("kind = 0").select("token", "g1", "g2", F.col("n").alias("i")).join(groups.drop("members"), ["g1", "g2"]).select("token", "gid", "n", "i")
    held = scratch.table(held, "held")
    shared = held.groupBy("gid").agg(F.count("*").alias("r")).withColumnRenamed("gid", "g0")
    once = scratch.table(held.join(shared, held.gid == shared.g0).select("token", "gid", "n", "r", "i"), "held")
    scratch.drop(entries, groups, held)
    held = once

    # sets of the classes that can be in a pair at all
    fewest = f"least({needed('n', '(4 * n + 4) div 5')}, {needed('n', '5 * n div 4')}, {needed('n', 'n')})"  # it rises up to equal sizes and falls from there, but for rounding by less than 4
    able = held.where(f"r + 4 >= {fewest}").select("gid").distinct().unionByName(members.where("members > 1").select("gid").distinct()).distinct()
    wanted = members.join(able, "gid", "left_semi").select("cid", F.col("d").alias("d2"), F.col("t").alias("t2"))
    texts = base.select("d", "t", "text").join(wanted, (F.col("d") == F.col("d2")) & (F.col("t") == F.col("t2"))).select("cid", "text")
    whole = scratch.table(texts.mapInArrow(_whole_sets, "cid long, items array<long>").dropDuplicates(["cid"]), "whole-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs of classes a < b."""
        a, b = whole.select(F.col("cid").alias("a"), F.col("items").alias("x")), whole.select(F.col("cid").alias("b"), F.col("items").alias("y"))
        both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
        return both.where("5L * common >= 4L * (size(x) + size(y) - common)").select("a", "b")

    def parts(found: DataFrame) -> DataFrame:
        """Classes with their component, or themselves where they have no link so far."""
        return members.join(found, members.cid == found.id, "left").select("cid", "gid", "n", "members", F.coalesce("component", "cid").alias("part"))

    def within(now: DataFrame, turn: int, last: bool) -> DataFrame:
        """Pairs of classes of one group: all of different components with one of the group's, chosen by hash; at last all that are left between different components."""
        large = now.where("members > 1").select("gid", "cid", "part")
        if last:
            apart = large.groupBy("gid").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("gid")
            left = large.join(apart, "gid", "left_semi")
            both = left.join(left.select("gid", F.col("cid").alias("b"), F.col("part").alias("part2")), "gid").where("cid < b and part <> part2")
            return both.select(F.col("cid").alias("a"), "b")
        hub = large.groupBy("gid").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "cid"), "cid", "part")).alias("hub"))
        both = large.join(hub, "gid").where("part <> hub.part")
        return both.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b"))

    def between(near: DataFrame, now: DataFrame, last: bool) -> DataFrame:
        """Pairs of classes of pairs of groups: one class for each component of a group, and at last all of different components."""
        own = now.select("gid", "cid", "part") if last else now.groupBy("gid", "part").agg(F.min("cid").alias("cid"))
        left, right = own.select(F.col("gid").alias("p"), F.col("cid").alias("a0"), "part"), own.select(F.col("gid").alias("q"), F.col("cid").alias("b0"), F.col("part").alias("part2"))
        return near.join(left, "p").join(right, "q").where("part <> part2").select(F.least("a0", "b0").alias("a"), F.greatest("a0", "b0").alias("b"))

    now = members.select("cid", "gid", "n", "members", F.col("cid").alias("part"))
    links = scratch.table(verified(within(now, -1, False)), "links")
    found = components(links)
    for turn in range(rounds + 1):
        last = turn == rounds
        now = scratch.table(parts(found), "now")
        # a group has the component of its classes if it is the same for all, else none that another group could have
        own = now.groupBy(F.col("gid").alias("g")).agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
        own = own.select("g", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1 - F.col("g")).alias("part"))
        parted = held.join(own, held.gid == own.g).select("token", "gid", "n", "r", "i", "part")
        counted = parted.groupBy("token", "part").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("within"))
        parted = scratch.table(parted.join(counted.where("all * all > within").select("token"), "token", "left_semi"), "parted")
        # cap: how many shingles that two prefixes share can be this one or behind it; rest: the shingles outside the prefix. Both are of a row, so that a pair costs a few additions
        most = F.expr(f"least(r, {prefix_sql('n')} - i)") if last else F.col("r")
        entry = parted.select("token", F.col("gid").alias("p"), "n", F.expr(f"int(n - {prefix_sql('n')})").alias("rest"), most.cast("int").alias("cap"), "part")
        if last:
            # the first shingle that two prefixes share has all others that they must share behind it, so only that far from the end are pairs looked for
            entry = entry.where(f"cap + 4 >= {fewest}")
            other = entry.select("token", F.col("p").alias("q"), F.col("n").alias("m"), F.col("rest").alias("rest2"), F.col("cap").alias("cap2"), F.col("part").alias("part2"))
            apart = (F.col("p") < F.col("q")) & (F.col("part") != F.col("part2"))
        else:
            order = [F.lit(0.0) if turn else -F.col("cap") / (F.col("n") - F.col("rest")), F.xxhash64(F.lit(turn), "p")]
            first = entry.groupBy("token").agg(F.min(F.struct(*order, "p", "n", "rest", "cap", "part")).alias("first"))
            other = first.select("token", F.col("first.p").alias("q"), F.col("first.n").alias("m"), F.col("first.rest").alias("rest2"), F.col("first.cap").alias("cap2"), F.col("first.part").alias("part2"))
            apart = F.col("part") != F.col("part2")
        pairs = entry.join(other, "token").where(apart & F.expr(f"{fits('n', 'm')} and {enough('least(cap, cap2)', 'greatest(rest, rest2)', 'n', 'm')}"))
        pairs = pairs.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.count("*").alias("common"), F.min(F.expr(needed("n", "m"))).alias("least"))
        if last:  # what was found at early places only is counted over the whole prefixes
            pairs = scratch.table(pairs, "pairs")
            tokens = lambda x, y: parted.groupBy(F.col("gid").alias(x)).agg(F.collect_list("token").alias(y))
            both = pairs.join(tokens("p", "x"), "p").join(tokens("q", "y"), "q")
            near = both.where(F.size(F.array_intersect("x", "y")) >= F.col("least")).select("p", "q")
        else:
            near = pairs.where("common >= least").select("p", "q")
        more = scratch.table(verified(within(now, turn, last).unionByName(between(near, now, last)).distinct()), "links")
        links = links.unionByName(more)
        scratch.drop(parted, found, now)
        found = components(links)
    named = rows.join(classes.select("c1", "c2", "cid"), ["c1", "c2"], "left")
    return named.join(found, F.col("cid") == F.col("id"), "left").select("doc_id", "d", "t", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "cid")).alias("part"))


def op6(docs: DataFrame) -> DataFrame:
    rows = scratch.table(linked(docs.select("doc_id", "text")), "linked")
    least = rows.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "part", "left").select("doc_id", "n_shingles", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id; documents without shingles all stay."""
    rows = scratch.table(linked(docs.select("doc_id", "text")), "linked")
    kept = rows.where("part is not null").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "d", "t")).alias("k")).select("k.d", "k.t")
    kept = kept.unionByName(rows.where("part is null").select("d", "t").distinct())
    # repeated rows of a component's document are one; those without words are told apart by their places
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    place = F.when(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")), F.lit(None)).otherwise(F.monotonically_increasing_id())
    own = docs.select(row, F.col("text").alias("x"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.hash("text").alias("t"), place.alias("place"))
    return own.join(kept, ["d", "t"], "left_semi").dropDuplicates(["d", "t", "x", "place"]).select("row.*")
