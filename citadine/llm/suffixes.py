"""Operator 10: substring deduplication by suffix trees of prefix-partitioned groups.

A repeat is a node of the corpus's suffix tree at a depth of ``length`` words or more; its leaves are the places where it begins. Suffixes are taken at word boundaries and cut at
``length`` words. Each batch of a mapper builds the subtree of its own suffixes, and each group that of the suffixes which came to it: they are sorted, the common prefixes of
neighbours are measured word by word, and neighbours that share ``length`` words lie below one deep internal node (see ``nodes``).

Variable-length prefixes split the suffixes into groups that fit memory. Among the runs of ``ANCHOR`` words in a window the one with the smallest hash is its anchor; equal windows
have equal anchors at equal places. A window goes where the first 1, 3 or 9 words of its anchor go: prefixes are counted for the whole corpus in tables of fixed size, one that is found too often
for a group is extended to the next length, and after the last the whole window decides. Neighbouring windows have mostly the same anchor, so they travel as one segment of
text, and a group compares words, not hashes of them.

Before that, suffixes that cannot be repeated are left out: a window whose anchor is found once in the corpus is unique. That filter is exact in this direction.

A window that is found in any number of places is settled in each batch of a mapper, where the first of its places goes on as the witness of all, so no group grows with the number of
copies in a batch. Repeated positions go back to their documents, and the words that repeated windows cover are removed.

Null and empty texts have no words; texts shorter than a window lose none. Rows that share a doc_id are told apart by their texts' hashes, and
equal rows are repeats of each other. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadine.llm import located, scratch, words

LENGTH = 35
ANCHOR = 9  # words of a run that can be an anchor
PREFIXES = (1, 3, 9)
SLOTS = 1 << 16
GROUP_ANCHORS = 100_000  # of a group; their segments have some five million words
BATCH_WINDOWS = 500_000  # that a mapper holds
BLOCKS = 5  # of words, by whose hashes suffixes are sorted
MAX64 = np.uint64(2**64 - 1)
SEGMENTS = "bucket long, settled boolean, text binary, sizes binary, docs binary, tags binary, firsts binary, windows binary, states binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
ALONE, WITNESS, OTHER = 0, 1, 2


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[:-rest], values[rest:]) if rest else values


class Windows:
    """The words, windows and anchors of a piece of documents."""

    def __init__(self, piece: pa.RecordBatch, length: int):
        self.raw, offsets = words.text_bytes(piece.column("text"))
        self.starts, self.ends, self.firsts = words.word_spans(self.raw, offsets)
        self.hashes = words.span_hashes(self.raw, self.starts, self.ends)
        self.owner = words.document_of(self.firsts)
        n = len(self.hashes)
        self.runs = words.grams(self.hashes, ANCHOR)
        self.least = sliding(self.runs, length - ANCHOR + 1, np.minimum)  # of each window
        self.valid = self.owner[: n - length + 1] == self.owner[length - 1 :] if n >= length else np.zeros(0, bool)

    def anchors(self, length: int) -> np.ndarray:
        """Where the runs are that are the smallest of some window."""
        if not len(self.valid):
            return np.zeros(0, np.int64)
        pad = np.zeros(length - ANCHOR, np.uint64)
        most = sliding(np.concatenate([pad, np.where(self.valid, self.least, 0), pad]), length - ANCHOR + 1, np.maximum)
        return np.flatnonzero((most == self.runs) & (most > 0))

    def candidates(self, repeated: np.ndarray, length: int) -> np.ndarray:
        """Windows whose anchor is among the given runs."""
        marked = np.full(len(self.runs), MAX64)
        marked[repeated] = self.runs[repeated]
        return np.flatnonzero(self.valid & (sliding(marked, length - ANCHOR + 1, np.minimum) == self.least))

    def anchor_of(self, at: np.ndarray, length: int) -> np.ndarray:
        """The place of the anchor of each of the given windows: its last smallest run."""
        out, left = np.zeros(len(at), np.int64), np.arange(len(at))
        for step in range(length - ANCHOR, -1, -1):
            hit = self.runs[at[left] + step] == self.least[at[left]]
            out[left[hit]] = at[left[hit]] + step
            left = left[~hit]
        return out


def nodes(symbols: np.ndarray, hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For the suffixes that begin at ``at``: ALONE, or, below an internal node of depth ``length`` or more, WITNESS for its first place and OTHER for the rest.

    ``symbols`` are the words as numbers, ``hashes`` their hashes. Suffixes are sorted by the hashes of their blocks of words, an order that keeps equal beginnings together; the common prefix of
    neighbours is then measured by the symbols. Two different blocks with one hash could only part a node's leaves if they also lay between them in all other blocks; leaves
    that are neighbours of no equal suffix but share its blocks are compared once more with all of theirs.
    """
    out = np.full(len(at), ALONE, np.int8)
    if len(at) < 2:
        return out
    step = -(-length // BLOCKS)
    grams = words.grams(hashes, step)
    keys = [grams[at + min(k * step, length - step)] for k in range(BLOCKS)]
    order = np.lexsort((at, *reversed(keys)))
    left, right = at[order[:-1]], at[order[1:]]
    depth = np.zeros(len(left), np.int64)
    live = np.arange(len(left))
    for k in range(length):
        live = live[symbols[left[live] + k] == symbols[right[live] + k]]
        depth[live] += 1
        if not len(live):
            break
    deep = depth >= length
    alike = np.logical_and.reduce([k[order[:-1]] == k[order[1:]] for k in keys])
    for i in np.flatnonzero(alike & ~deep).tolist():  # equal hashes of different words
        _resolve(symbols, at, order, alike, i, length, deep)
    first = np.append(False, deep)
    out[order] = np.where(first, OTHER, np.where(np.append(deep, False), WITNESS, ALONE))
    return out


def _resolve(symbols: np.ndarray, at: np.ndarray, order: np.ndarray, alike: np.ndarray, i: int, length: int, deep: np.ndarray) -> None:
    """Sort the suffixes around place ``i`` that have equal hashes by their words."""
    i0 = i1 = i
    while i0 and alike[i0 - 1]:
        i0 -= 1
    while i1 + 1 < len(alike) and alike[i1 + 1]:
        i1 += 1
    own = sorted(order[i0 : i1 + 2].tolist(), key=lambda x: (symbols[at[x] : at[x] + length].tolist(), at[x]))
    order[i0 : i1 + 2] = own
    word = [symbols[at[x] : at[x] + length].tolist() for x in own]
    deep[i0 : i1 + 1] = [a == b for a, b in zip(word, word[1:])]


def numbered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for every word, the same for equal words only: their bytes are compared with those of the first word of the same hash."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    number = number.ravel()
    like = first[number]
    same = (ends - starts) == (ends[like] - starts[like])
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    live, done = np.flatnonzero(same), 0
    while len(live):
        size = np.minimum(ends[live] - starts[live] - done, 8)
        equal = ((lanes[starts[live] + done].view("<u8").ravel() ^ lanes[starts[like[live]] + done].view("<u8").ravel()) & words.MASKS[size]) == 0
        same[live[~equal]] = False
        live = live[equal & (size == 8)]
        done += 8
        live = live[ends[live] - starts[live] > done]
    if not same.all():  # words with equal hashes and different bytes
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            number[k] = known.setdefault(raw[starts[k] : ends[k]].tobytes(), len(first) + len(known))
    return number


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def _anchors(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = located.Dealer(buckets, lambda hi: (hi % np.uint64(buckets)).astype(np.int64))
        tables = np.zeros((len(PREFIXES), SLOTS), np.int64)
        for piece in words.pieces(batches):
            w = Windows(piece, length)
            found = w.anchors(length)
            for table, k in zip(tables, PREFIXES):
                table += np.bincount(slots(words.grams(w.hashes, k)[found]), minlength=SLOTS)
            doc = w.owner[found]
            d, t = (piece.column(c).to_numpy()[doc] for c in ("d", "t"))
            yield from dealer.add(w.runs[found], np.zeros(len(found), np.uint32), d, t, found - w.firsts[doc])
        yield from dealer.close()
        none = [b""] * len(tables)
        if tables.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - k for k in range(len(tables))], pa.int64()), pa.array([False] * len(tables)), pa.array([zlib.compress(x.tobytes(), 1) for x in tables], pa.binary()), *[pa.array(none, pa.binary())] * 4],
                names=[x.split()[0] for x in located.DEALT.split(", ")],
            )

    return run


def _repeated_anchors(dealt: pa.Table) -> pa.Table:
    bucket = dealt.column("bucket")[0].as_py()
    if bucket >= 0:
        return located.repeated_places(dealt)
    total = np.zeros(SLOTS, np.int64)
    for x in dealt.column("keys").to_pylist():
        total += np.frombuffer(zlib.decompress(x), np.int64)
    return pa.table({"kind": pa.array([1], pa.int32()), "d": pa.array([-1 - bucket], pa.int64()), "t": pa.array([0], pa.int32()), "pos": pa.array([total.tobytes()], pa.binary())})


def group_maps(tables: np.ndarray, budget: int) -> tuple[np.ndarray, int, int]:
    """For each prefix length and slot the group that holds its suffixes, or -1 if the prefix is to be extended; the number of groups by prefix, and of those by
    whole windows that follow. Neighbouring slots share a group as long as it fits."""
    maps, group, room = np.full(tables.shape, -1, np.int32), 0, budget
    rest = 0
    for level, table in enumerate(tables):
        for slot in np.flatnonzero((table > 0) & (table <= budget)).tolist():
            if table[slot] > room:
                group, room = group + 1, budget
            maps[level, slot] = group
            room -= int(table[slot])
        rest = int(table[table > budget].sum())
    return maps, group + 1, max(1, -(-rest // budget))


class Batch:
    """Candidate windows of some pieces, and the rows of SEGMENTS that they become."""

    def __init__(self, length: int, maps: np.ndarray, by_prefix: int, by_window: int, limit: int = BATCH_WINDOWS):
        self.length, self.maps, self.by_prefix, self.by_window, self.limit = length, maps, by_prefix, by_window, limit
        self.held: list[tuple[Windows, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = self.given = 0

    def add(self, w: Windows, at: np.ndarray, d: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(at):
            self.held.append((w, at, d, t))
            self.n += len(at)
        if self.n >= self.limit:
            yield self.flush()

    def groups(self, w: Windows, at: np.ndarray) -> np.ndarray:
        anchor = w.anchor_of(at, self.length)
        whole = words.mixed(words.grams(w.hashes, self.length)[at])
        out = self.by_prefix + (whole % np.uint64(self.by_window)).astype(np.int64)
        for level, k in reversed(list(enumerate(PREFIXES))):
            own = self.maps[level][slots(words.grams(w.hashes, k)[anchor])]
            out = np.where(own >= 0, own, out)
        return out

    def flush(self) -> pa.RecordBatch:
        shifts = np.cumsum([0, *(len(w.hashes) for w, *_ in self.held)])
        hashes = np.concatenate([w.hashes for w, *_ in self.held])
        states = nodes(hashes, hashes, np.concatenate([at + shift for (_, at, *_), shift in zip(self.held, shifts)]), self.length)
        parts, settled, cut = [], [], 0
        for w, at, d, t in self.held:
            state = states[cut : cut + len(at)]
            cut += len(at)
            doc = w.owner[at]
            place = at - w.firsts[doc]
            again = state != ALONE
            settled.append((d[doc[again]], t[doc[again]], place[again]))
            go = np.flatnonzero(state != OTHER)
            parts.append(self.segments(w, at[go], state[go], d, t))
        rows = []
        d, t, place = (np.concatenate(x) for x in zip(*settled))
        if len(d):
            docs, tags, counts, steps = located.packed(d, t, place)
            rows.append((self.by_prefix + self.by_window + self.given % (self.by_prefix + self.by_window), True, b"", b"", docs, tags, counts, steps, b""))
        self.given += 1
        group = np.concatenate([p[0] for p in parts])
        order = np.argsort(group, kind="stable")
        texts = [x for p in parts for x in p[1]]
        states = [x for p in parts for x in p[2]]
        columns = [np.concatenate([p[k] for p in parts]) for k in (3, 4, 5, 6)]
        starts = located.runs_of(group[order])
        for i, j in zip(starts, np.append(starts[1:], len(order))):
            own = order[i:j]
            body = [texts[k] for k in own.tolist()]
            docs, tags, firsts, windows = (c[own] for c in columns)
            rows.append((int(group[own[0]]), False, b"".join(body), np.array([len(x) for x in body], np.uint32).tobytes(), docs.tobytes(), tags.tobytes(), firsts.astype(np.uint32).tobytes(), windows.astype(np.uint32).tobytes(), b"".join(states[k] for k in own.tolist())))
        self.held, self.n = [], 0
        kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    def segments(self, w: Windows, at: np.ndarray, state: np.ndarray, d: np.ndarray, t: np.ndarray):
        """Runs of consecutive windows of one group: group, text, states, document, tag, first word, number of windows."""
        group, doc = self.groups(w, at), w.owner[at]
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(at))
        raw, marks = w.raw.tobytes(), state.tobytes()
        begin, end = w.starts[at[first]], w.ends[at[last - 1] + self.length - 1] if len(at) else at
        texts = [raw[i:j] for i, j in zip(begin.tolist(), end.tolist())]
        own = doc[first]
        return group[first], texts, [marks[i:j] for i, j in zip(first.tolist(), last.tolist())], d[own], t[own], at[first] - w.firsts[own], last - first

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield self.flush()


def _suffixes(length: int, maps: np.ndarray, by_prefix: int, by_window: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = Batch(length, maps, by_prefix, by_window, limit)
        for piece in words.pieces(batches):
            w = Windows(piece, length)
            lists = piece.column("anchors").to_pylist()
            marked = [first + np.frombuffer(x, np.uint32).astype(np.int64) for first, xs in zip(w.firsts, lists) for x in xs or ()]
            if marked:
                yield from batch.add(w, w.candidates(np.concatenate(marked), length), piece.column("d").to_numpy(), piece.column("t").to_numpy())
        yield from batch.close()

    return run


def _subtree(length: int):
    def run(dealt: pa.Table) -> pa.Table:
        """The places of one group that lie below its deep internal nodes, and those that were settled before."""
        outs, rows = [], []
        for row in dealt.to_pylist():
            if row["settled"]:
                outs.append(located.places(*located.unpacked({"docs": row["docs"], "tags": row["tags"], "counts": row["firsts"], "pos": row["windows"]})))
            else:
                rows.append(row)
        if not rows:
            return pa.concat_tables(outs)
        joined = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        raw, windows = joined("text", np.uint8), joined("windows", np.uint32).astype(np.int64)
        starts, ends, firsts = words.word_spans(raw, np.append(0, np.cumsum(joined("sizes", np.uint32).astype(np.int64))))
        hashes = words.span_hashes(raw, starts, ends)
        segment = np.repeat(np.arange(len(windows)), windows)
        step = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
        state = nodes(numbered(raw, starts, ends, hashes), hashes, firsts[segment] + step, length)
        again = (state != ALONE) & (joined("states", np.int8) == ALONE)
        segment, step = segment[again], step[again]
        d, t, first = joined("docs", np.int64), joined("tags", np.int32), joined("firsts", np.uint32).astype(np.int64)
        order = np.lexsort((first[segment] + step, t[segment], d[segment]))
        segment, step = segment[order], step[order]
        return pa.concat_tables([*outs, located.places(d[segment], t[segment], first[segment] + step)])

    return run


def _kept(length: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(iter([batch])):
                out = []
                for text, lists in zip(piece.column("text").to_pylist(), piece.column("places").to_pylist()):
                    found = (text or "").encode().split()
                    n = len(found)
                    if lists:
                        starts = np.concatenate([np.frombuffer(x, np.uint32) for x in lists]).astype(np.int64)
                        found = list(compress(found, ~words.covered(starts, length, n)))
                    kept = b" ".join(found)
                    out.append((n, n - len(found), hashlib.sha256(kept).hexdigest() if digests else kept.decode()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string())))], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def removed(docs: DataFrame, length: int = LENGTH, digests: bool = True, limit: int = BATCH_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces (their sha256, if ``digests``)."""
    base = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.hash("text").alias("t"))
    buckets = max(24, scratch.text_bytes(docs) >> 25)  # of some 32 MB of text; two buckets per core at least on a small cluster
    dealt = base.select("d", "t", "text").mapInArrow(_anchors(length, buckets), located.DEALT)
    found = scratch.table(dealt.groupBy("bucket").applyInArrow(_repeated_anchors, located.PLACES), "anchors")
    counts = found.where("kind = 1").collect()  # tables of fixed size
    tables = np.zeros((len(PREFIXES), SLOTS), np.int64)
    for r in counts:
        tables[r["d"]] = np.frombuffer(r["pos"], np.int64)
    budget = max(1000, min(GROUP_ANCHORS, int(tables[0].sum()) // buckets))
    maps, by_prefix, by_window = group_maps(tables, budget)
    lists = lambda places, name: places.where("kind = 0").groupBy(F.col("d").alias("d2"), F.col("t").alias("t2")).agg(F.collect_list("pos").alias(name))
    own = (F.col("d") == F.col("d2")) & (F.col("t") == F.col("t2"))
    marked = base.join(lists(found, "anchors"), own, "left").where("anchors is not null").select("doc_id", "d", "t", "text", "anchors")  # the columns of the last join: both read one exchange of the texts
    suffixes = marked.mapInArrow(_suffixes(length, maps, by_prefix, by_window, limit), SEGMENTS)
    places = suffixes.groupBy("bucket").applyInArrow(_subtree(length), located.PLACES)
    return base.join(lists(places, "places"), own, "left").select("doc_id", "text", "places").mapInArrow(_kept(length, digests), RESULT)


def op10(docs: DataFrame) -> DataFrame:
    return removed(docs.select("doc_id", "text"))
