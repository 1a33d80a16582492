"""Connected regions of a field with persistence, grown regions, and null replicates.

Regions are a spanning forest. Arcs are sorted by their lower end, and the first pass over them, which knows no threshold, gives each peak its saddle: where
its hill first meets a higher one. The peaks that rise far enough above their saddles are kept, and a second pass joins the ends of arcs, highest first, unless that would
join two kept peaks. One tree so serves any number of thresholds.

A month's field above its floor is one task's work; months, replicates and parameters run in parallel. The network goes to the tasks as packed arrays, a broadcast of checked
size that the driver passes on without unpacking it; a larger network's arcs come to each group as rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citadine import storage
from citadine.operators.field import above_floor

REGION = "peak long, node_id long, persistence double, peak_f double, f double"
MOST_ARCS = 5_000_000
MOST_PAIRS = 40_000_000


@dataclass
class Network:
    """Nodes in order of their ids; the neighbours of node i are to[start[i]:start[i + 1]], in order."""

    ids: np.ndarray
    start: np.ndarray
    to: np.ndarray

    @classmethod
    def of(cls, src: np.ndarray, dst: np.ndarray) -> Network:
        ids, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = both.ravel()[: len(src)], both.ravel()[len(src) :]
        order = np.lexsort((b, a))
        return cls(ids, np.searchsorted(a[order], np.arange(len(ids) + 1)), b[order])

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """Where nodes are in ``ids``, -1 for those without an arc."""
        at = np.minimum(np.searchsorted(self.ids, nodes), max(0, len(self.ids) - 1))
        return np.where(self.ids[at] == nodes, at, -1) if len(self.ids) else np.full(len(nodes), -1)

    def within(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs whose ends are both among ``nodes``, as places in it."""
        return self.among(self.places(nodes))

    def among(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs whose ends are both among the nodes at these places (-1: none), as positions in ``at``."""
        known = np.flatnonzero(at >= 0)
        local = np.full(len(self.ids), -1)
        local[at[known]] = known
        arcs, n = self.arcs(at[known])
        source, target = np.repeat(known, n), local[self.to[arcs]]
        inside = target >= 0
        return source[inside], target[inside]

    def arcs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``to`` the neighbours of the nodes at these places are, and how many each has."""
        start, n = self.start[at], self.start[at + 1] - self.start[at]
        kind = np.int32 if len(self.to) < 2**31 else np.int64
        return np.repeat((start - (np.cumsum(n) - n)).astype(kind), n) + np.arange(n.sum(), dtype=kind), n

    def near(self, node: int) -> list[int]:
        at = int(np.searchsorted(self.ids, node))
        return self.ids[self.to[self.start[at] : self.start[at + 1]]].tolist() if at < len(self.ids) and self.ids[at] == node else []


class Packed:
    """A network as compressed slices of nodes in order, which are unpacked where they are first used: (first id, ids, neighbours of each, neighbours, distinct lengths, number of each
    one's length). Ids are differences from the one before, and neighbours from their node."""

    def __init__(self, slices: list[tuple]):
        self.slices, self.open, self.far = sorted(slices, key=lambda x: x[0]), None, None

    def __getstate__(self):
        return {"slices": self.slices, "open": None, "far": None}

    def _column(self, k: int, kind):
        return (np.frombuffer(zlib.decompress(x[k]), kind) for x in self.slices)

    @property
    def network(self) -> Network:
        """Unpacked slice by slice, so a task holds no second copy of the whole."""
        if self.open is None:
            own, n = [np.cumsum(x) for x in self._column(1, np.int64)], list(self._column(2, np.int32))
            ids, counts, to = np.concatenate([np.empty(0, np.int64), *own]), np.concatenate([np.empty(0, np.int32), *n]), []
            ends = lambda: (near + np.repeat(a, b) for a, b, near in zip(own, n, self._column(3, np.int64)))
            lost = [end[ids[np.minimum(np.searchsorted(ids, end), len(ids) - 1)] != end] for end in ends()]
            if sum(map(len, lost)):  # those without neighbours of their own
                known, ids = ids, np.union1d(ids, np.concatenate(lost))
                counts, had = np.zeros(len(ids), np.int32), counts
                counts[np.searchsorted(ids, known)] = had
            to = [np.searchsorted(ids, end).astype(np.int32) for end in ends()]
            self.open = Network(ids, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), np.concatenate([np.empty(0, np.int32), *to]))
        return self.open

    def _lengths(self) -> tuple[np.ndarray, np.ndarray | None]:
        """The distinct lengths and the number of each arc's one, or, if they are too many, all lengths and None."""
        if self.far is None:
            values = list(self._column(4, np.float64))
            kinds = np.unique(np.concatenate([np.empty(0), *values]))
            numbers = zip(values, self._column(5, np.uint32))
            if len(kinds) <= 1 << 16:
                self.far = kinds, np.concatenate([np.empty(0, np.uint16), *(np.searchsorted(kinds, v).astype(np.uint16)[k] for v, k in numbers)])
            else:
                self.far = np.concatenate([np.empty(0), *(v[k] for v, k in numbers)]), None
        return self.far

    @property
    def lengths(self) -> np.ndarray:
        """Of the arcs in the order of ``network.to``."""
        lengths, number = self._lengths()
        return lengths if number is None else lengths[number]

    def weights(self, sigma: float, reach: float | None = None):
        """A function from places in ``network.to`` to the weights exp(-d^2 / 2 sigma^2) of their lengths, 0 beyond ``reach``."""
        lengths, number = self._lengths()
        of = lambda d: np.where(d <= (np.inf if reach is None else reach), np.exp(-d * d / (2 * sigma * sigma)), 0.0)
        if number is None:
            return lambda at: of(lengths[at])
        known = of(lengths)
        return lambda at: known[number[at]]

    def field(self, own: np.ndarray, weights, block: int = 1 << 15) -> np.ndarray:
        """The field of counts, both by the places of ``network.ids``; some sources at a time, so that little is held for the pairs."""
        net, sources, out = self.network, np.flatnonzero(own), np.zeros(len(self.network.ids))
        for i in range(0, len(sources), block):
            source = sources[i : i + block]
            at, n = net.arcs(source)
            out += np.bincount(net.to[at], weights(at) * np.repeat(own[source], n), len(out))
        return out

    def settled(self) -> Packed:
        """Itself, unpacked, without the slices: for tasks, which pass it on to no one."""
        if self.slices:
            self.network, self._lengths()
            self.slices = []
        return self


PACKED = "first long, ids binary, n binary, near binary, kinds binary, lengths binary"


def _columns(src: np.ndarray, dst: np.ndarray, length: np.ndarray) -> tuple:
    """A row of PACKED of arcs in order of their nodes."""
    ids, n = np.unique(src, return_counts=True)
    kinds, number = np.unique(length, return_inverse=True)
    columns = [np.diff(ids, prepend=0), n.astype(np.int32), dst - src, kinds, number.astype(np.uint32)]
    return int(ids[0]) if len(ids) else 0, *(zlib.compress(c.tobytes(), 1) for c in columns)


def _packs(batches):
    """One row of PACKED for all nodes of a partition, whose arcs come in order."""
    rows = [[batch.column(c).to_numpy() for c in ("src", "dst", "length")] for batch in batches if batch.num_rows]
    if rows:
        first, *columns = _columns(*(np.concatenate(c) for c in zip(*rows)))
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], [x.split()[0] for x in PACKED.split(", ")])


def packed(arcs: DataFrame, slices: int = 16) -> Packed:
    """The network of arcs (src, dst and, if they have it, length), packed by tasks; the compressed slices are all that comes to the driver."""
    length = F.col("length").cast("double") if "length" in arcs.columns else F.lit(0.0)
    ends = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), length.alias("length"))
    rows = ends.repartitionByRange(slices, "src").sortWithinPartitions("src", "dst", "length").mapInArrow(_packs, PACKED).collect()
    return Packed([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows])


class Spread:
    """A broadcast of a packed network; ``value`` is the network."""

    def __init__(self, shared):
        self.shared = shared

    @property
    def value(self) -> Network:
        return self.shared.value.network


def spread(arcs: DataFrame) -> Spread | None:
    """The network as a broadcast, or None if it has more than MOST_ARCS arcs."""
    if arcs.count() > MOST_ARCS:
        return None
    return Spread(arcs.sparkSession.sparkContext.broadcast(packed(arcs.select("src", "dst"))))


def spread_pairs(distances):
    """The kernel (src, dst, d) as a broadcast of a Packed network, or None if it has more than MOST_PAIRS pairs. ``distances`` may be such a broadcast already."""
    if not isinstance(distances, DataFrame):
        return distances
    if distances.count() > MOST_PAIRS:
        return None
    return distances.sparkSession.sparkContext.broadcast(packed(distances.select("src", "dst", F.col("d").alias("length")), 64))


def reached(net: Network, lengths: np.ndarray, sources: np.ndarray, cutoff: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest distances up to ``cutoff`` from places by paths of up to ``rounds`` arcs: source, target, d. A round goes on from what the one before it found or shortened."""
    n = len(net.ids)
    keys = np.arange(len(sources)) * n + sources
    d, new = np.zeros(len(keys)), slice(None)
    for _ in range(rounds):
        source, via = np.divmod(keys[new], n)
        arcs, count = net.arcs(via)
        far = np.repeat(d[new], count) + lengths[arcs]
        near = far <= cutoff
        found, far = (np.repeat(source * n, count) + net.to[arcs])[near], far[near]
        found, far = np.concatenate([keys, found]), np.concatenate([d, far])
        order = np.argsort(found)
        found, far = found[order], far[order]
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.empty(0, np.int64)
        known, was = keys, d
        keys, d = found[first], np.minimum.reduceat(far, first) if len(first) else far
        shorter = np.ones(len(keys), bool)
        at = np.searchsorted(keys, known)
        shorter[at] = d[at] < was
        new = np.flatnonzero(shorter)
        if not len(new):
            break
    source, target = np.divmod(keys, max(1, n))
    return sources[source], target, d


def _reaching(arcs: DataFrame, cutoff: float, rounds: int, schema: str, of, block: int = 10_000) -> DataFrame | None:
    """``of`` what is ``reached`` from blocks of all nodes, as (network, source, target, d); None if there are more than MOST_ARCS arcs."""
    if arcs.count() > MOST_ARCS:
        return None
    spark = arcs.sparkSession
    shared = spark.sparkContext.broadcast(packed(arcs.select("src", "dst", "length")))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        net, lengths = shared.value.network, shared.value.lengths
        for batch in batches:
            for i in batch.column("id").to_pylist():
                own = np.arange(i * block, min((i + 1) * block, len(net.ids)))
                yield pa.RecordBatch.from_arrays(of(net, *reached(net, lengths, own[net.start[own + 1] > net.start[own]], cutoff, rounds)), names)

    blocks = -(-len(shared.value.network.ids) // block)
    return spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(run, schema)


def kernel_in_arrays(arcs: DataFrame, cutoff: float, rounds: int) -> DataFrame | None:
    """What ``field.kernel`` gives for all nodes, with no row per path; None if there are more than MOST_ARCS arcs."""
    return _reaching(arcs, cutoff, rounds, "src long, dst long, d double", lambda net, source, target, d: [pa.array(net.ids[source]), pa.array(net.ids[target]), pa.array(d)])


def packed_kernel(arcs: DataFrame, cutoff: float, rounds: int):
    """The kernel of all nodes as a broadcast of a Packed network, made and packed by tasks; None if it has more than MOST_PAIRS pairs, or the network more than MOST_ARCS arcs."""
    each = _reaching(arcs, cutoff, rounds, "n long", lambda net, source, target, d: [pa.array([len(d)], pa.int64())])
    if each is None or (each.agg(F.sum("n")).first()[0] or 0) > MOST_PAIRS:
        return None

    def of(net, source, target, d):
        columns = _columns(net.ids[source], net.ids[target], d)
        return [pa.array([c], t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 5))]

    rows = _reaching(arcs, cutoff, rounds, PACKED, of).collect()
    return arcs.sparkSession.sparkContext.broadcast(Packed([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows]))


class Forest:
    """Hills of a field: places by rank, the highest first (the smaller id among equals), and arcs by their lower end."""

    def __init__(self, ids: np.ndarray, heights: np.ndarray, source: np.ndarray, target: np.ndarray):
        order = _descending(heights) if (np.diff(ids) > 0).all() else np.lexsort((ids, -heights))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.order, self.ids, self.heights = order, ids[order], heights[order]
        a, b = rank[source], rank[target]
        low, high = np.maximum(a, b), np.minimum(a, b)
        self.low, self.high = _parts(_distinct(((low << (bits := len(order).bit_length())) + high)[low > high]), bits)
        self.first = np.flatnonzero(np.append(True, self.low[1:] != self.low[:-1])) if len(self.low) else np.empty(0, np.int64)
        self.slopes, self.below = self.low[self.first], None
        self._join()

    @staticmethod
    def _ends(above: np.ndarray) -> np.ndarray:
        """Where each place's way up ends."""
        while not np.array_equal(above, further := above[above]):
            above = further
        return above

    def _join(self) -> None:
        """For each place its hill, and for each place that tops one the place where that first meets a higher hill (``saddle``: its own for slopes, and -1 where it never does) and the
        top of what it joins there (``parent``).

        A slope goes with its highest neighbour, so hills meet only at arcs between their slopes, and of two hills' arcs the highest counts."""
        n = len(self.ids)
        up, self.saddle, self.parent = np.arange(n), np.full(n, -1), np.full(n, -1)
        up[self.slopes], self.saddle[self.slopes] = self.high[self.first], self.slopes
        self.hill = hill = self._ends(up)
        self.peaks = np.flatnonzero(hill == np.arange(n))
        number = np.empty(n, np.int64)
        number[self.peaks] = np.arange(len(self.peaks))
        a, b = number[hill[self.low]], number[hill[self.high]]
        apart = np.flatnonzero(a != b)
        a, b = a[apart], b[apart]
        bits = len(self.peaks).bit_length()
        at = _firsts((np.minimum(a, b) << bits) + np.maximum(a, b), 2 * bits)
        above, lower, place, best = list(range(len(self.peaks))), [], [], []
        for low, x, y in zip(self.low[apart[at]].tolist(), a[at].tolist(), b[at].tolist()):
            while above[x] != x:
                above[x] = x = above[above[x]]
            while above[y] != y:
                above[y] = y = above[above[y]]
            if x != y:
                if x > y:
                    x, y = y, x
                above[y] = x
                lower.append(y)
                place.append(low)
                best.append(x)
        lower = self.peaks[np.array(lower, np.int64)]
        self.saddle[lower], self.parent[lower] = place, self.peaks[np.array(best, np.int64)]

    def kept(self, tau: float, size: int) -> np.ndarray:
        """Whether a place among the first ``size`` is a peak that rises ``tau`` or more above its saddle, or meets no higher one there."""
        saddle, place = self.saddle[:size], np.arange(size)
        free = (saddle < 0) | (saddle >= size)
        return free | ((saddle != place) & (self.heights[:size] - self.heights[np.where(free, 0, saddle)] >= tau))

    def _arcs(self, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some slopes, by their number, where their arcs begin in a list of these arcs, and the list."""
        n = np.append(self.first, len(self.low))[slopes + 1] - self.first[slopes]
        begin = np.cumsum(n) - n
        return begin, np.repeat(self.first[slopes] - begin, n) + np.arange(n.sum())

    def _marks(self, mark: np.ndarray) -> np.ndarray:
        """A place whose higher neighbours all have one mark gets it too; the others get their own. ``mark`` has those of the peaks and a guess for the slopes; what hangs on a wrong guess is looked at again."""
        if self.below is None:
            number = np.repeat(np.arange(len(self.slopes)), np.diff(np.append(self.first, len(self.low))))
            bits = len(self.slopes).bit_length()
            self.below = np.append(0, np.cumsum(np.bincount(self.high, minlength=len(self.ids)))), _parts(np.sort((self.high << bits) + number), bits)[1]
        start, lower = self.below
        open_ = np.arange(len(self.slopes))
        while len(open_):
            begin, arcs = self._arcs(open_) if len(open_) < len(self.slopes) else (self.first, slice(None))
            near = mark[self.high[arcs]]
            least = np.minimum.reduceat(near, begin)
            own = self.slopes[open_]
            new = np.where(least == np.maximum.reduceat(near, begin), least, own)
            changed = own[new != mark[own]]
            mark[own] = new
            n = start[changed + 1] - start[changed]
            again = np.zeros(len(self.slopes), bool)
            again[lower[np.repeat(start[changed] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
            open_ = np.flatnonzero(again)
        return mark

    def joins(self, tau: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How regions grow from the highest place down: ``named``, the peaks and the places where hills meet; for each place the number of its own among these; and what each of
        them is joined to (itself, if to none), by number, and at which place. What is above a floor is the joins before its first place below it.

        Hills that are not kept join the higher ones that they meet, all in one step as long as no two kept ones have met there: such a part is one region. Beyond, a place whose higher
        neighbours all have one mark gets it too, whatever becomes of that mark's region; the others, each a mark of its own, are joined one after the other."""
        n = len(self.ids)
        kept, saddle, parent, peaks = self.kept(tau, n), self.saddle, self.parent, self.peaks
        met = np.full(n, n)  # the place where a peak's hill first meets a lower kept one
        lower = peaks[kept[peaks] & (parent[peaks] >= 0)]
        np.minimum.at(met, parent[lower], saddle[lower])
        free = peaks[~kept[peaks]]
        joined = parent[free]
        sole = (saddle[free] < met[joined]) & ~(kept[joined] & (saddle[joined] == saddle[free]))
        up = np.arange(n)
        up[free[sole]] = joined[sole]
        up[peaks] = self._ends(up)[peaks]
        mark = self._marks(up[self.hill])
        name = np.flatnonzero(mark[self.slopes] == self.slopes)
        begin, arcs = self._arcs(name)
        own = np.zeros(n, bool)
        own[peaks] = own[self.slopes[name]] = True
        named, number = np.flatnonzero(own), np.cumsum(own) - 1
        count = np.diff(np.append(begin, len(arcs)))
        bits = len(named).bit_length()
        places, marks = _parts(_distinct((np.repeat(number[self.slopes[name]], count) << bits) + number[mark[self.high[arcs]]]), bits)
        cuts = np.append(np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else [], len(places)).astype(int)
        above, keeps, bests, lower, best, at = list(range(len(named))), kept[named].tolist(), [], [], [], []
        marks, bounds, places = marks.tolist(), cuts.tolist(), places[cuts[:-1]]
        for place, i, j in zip(places.tolist(), bounds, bounds[1:]):
            top, others = marks[i], ()
            while above[top] != top:
                above[top] = top = above[above[top]]
            for x in marks[i + 1 : j]:
                while above[x] != x:
                    above[x] = x = above[above[x]]
                if x > top:
                    if not keeps[x]:
                        others = (*others, x)
                elif x < top:
                    if not keeps[top]:
                        others = (*others, top)
                    top = x
            above[place] = top
            bests.append(top)
            for x in others:
                if above[x] == x:
                    above[x] = top
                    lower.append(x)
                    best.append(top)
                    at.append(place)
        to, when = np.arange(len(named)), np.full(len(named), n)
        to[places], when[places] = bests, named[places]
        to[lower], when[lower] = best, named[at]
        part = number[free[sole]]
        to[part], when[part] = number[joined[sole]], saddle[free[sole]]
        peak = np.zeros(n, bool)
        peak[peaks] = True
        return named, number[np.where(peak[mark], self.hill, mark)], to, when

    def homes(self, to: np.ndarray, when: np.ndarray, size: int) -> np.ndarray:
        """What each of ``named`` is part of, by number, when the first ``size`` places are joined."""
        return self._ends(np.where(when < size, to, np.arange(len(to))))

    def regions(self, tau: float, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the ``size`` highest places (all, if not given) the peak (by rank) of each one's region, and what each region's peak rises above the last place where it meets a higher
        region (its whole height if there is none)."""
        size = len(self.ids) if size is None else size
        named, own, to, when = self.joins(tau)
        home = named[self.homes(to, when, size)[own[:size]]]
        n = int(np.searchsorted(self.low, size))
        low, high = self.low[:n], self.high[:n]
        last = np.full(size, -1)
        border = home[low] != home[high]
        np.maximum.at(last, home[high[border]], low[border])
        return home, np.where(last < 0, self.heights[:size], self.heights[:size] - self.heights[last])

    def sums(self, tau: float, sizes: list[int], counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each number of highest places, the nodes and counts of its regions, by the ranks of their peaks."""
        named, own, to, when = self.joins(tau)
        nodes, captured, done, found = np.zeros(len(named), np.int64), np.zeros(len(named)), 0, {}
        for size in sorted(set(sizes)):
            new = slice(done, size)
            nodes += np.bincount(own[new], minlength=len(named))
            captured += np.bincount(own[new], counts[new], len(named))
            home, done = self.homes(to, when, size), size
            found[size] = np.bincount(home, nodes, len(named)).astype(np.int64), np.bincount(home, captured, len(named))
        return [found[size] for size in sizes]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct numbers in order."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _parts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What is above the last ``bits`` of numbers, and these."""
    return keys >> bits, keys & ((1 << bits) - 1)


def _firsts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each distinct number of up to ``bits`` is first, in order of these places. Sorting numbers that carry their places is much faster than sorting places by them."""
    own = len(keys).bit_length()
    if bits + own > 62:
        return np.sort(np.unique(keys, return_index=True)[1])
    key, at = _parts(np.sort((keys << own) + np.arange(len(keys))), own)
    return np.sort(at[np.append(True, key[1:] != key[:-1])]) if len(at) else at


def _descending(heights: np.ndarray) -> np.ndarray:
    """The places of heights, the highest first, and of equals the first. Heights of 9 digits are sorted as numbers that carry their places."""
    bits, top = len(heights).bit_length(), heights.max(initial=0.0)
    if top < 2 ** (62 - bits) / 1e9 and top < 2**50 / 1e9 and heights.min(initial=0.0) >= 0:
        whole = np.rint(heights * 1e9)
        if np.array_equal(whole / 1e9, heights):
            return _parts(np.sort(((whole.max(initial=0.0) - whole).astype(np.int64) << bits) + np.arange(len(heights))), bits)[1]
    return np.argsort(-heights, kind="stable")


def partitioned(ids: np.ndarray, heights: np.ndarray, source: np.ndarray, target: np.ndarray, taus: list[float]) -> list[pd.DataFrame]:
    """For each threshold a row of REGION per node."""
    forest, out = Forest(ids, heights, source, target), []
    for tau in taus:
        home, rise = forest.regions(tau)
        out.append(pd.DataFrame({"peak": forest.ids[home], "node_id": forest.ids, "persistence": rise[home], "peak_f": forest.heights[home], "f": forest.heights}))
    return out


def top_of(size: np.ndarray, captured: np.ndarray, ks: list[int]) -> list[tuple[int, int, int]]:
    """Incidents, nodes and number of the first k regions by incidents and height of the peak, for each k; regions without incidents don't count. Regions come by the height of their peaks."""
    peaks = np.flatnonzero(captured > 0)
    found, most = len(peaks), max(ks)
    if found > most:
        peaks = peaks[captured[peaks] >= np.partition(captured[peaks], found - most)[found - most]]
    peaks = peaks[np.argsort(-captured[peaks], kind="stable")]
    return [(int(captured[peaks[:k]].sum()), int(size[peaks[:k]].sum()), min(k, found)) for k in ks]


SWEPT = "alpha double, f_min double, k int, captured long, nodes long, hotspots int"


def swept_field(ids: np.ndarray, field: np.ndarray, counts: np.ndarray, arcs: tuple[np.ndarray, np.ndarray], alphas: list[float], floors: list[float], ks: list[int]) -> list[tuple]:
    """A row of SWEPT for each persistence threshold, floor and number of regions of a field, which is given above its lowest floor. Its forest is built once; a threshold joins it once, and a
    higher floor is the joins before its last place."""
    heights = field.round(9)
    forest = Forest(ids, heights, *arcs)
    counts, exact = counts[forest.order], field[forest.order]
    sizes = [int((exact >= floor * exact.max()).sum()) for floor in floors]
    return [(alpha, floor, k, *found) for alpha in alphas for floor, own in zip(floors, forest.sums(alpha * heights.max(), sizes, counts)) for k, found in zip(ks, top_of(*own, ks))]


def swept(field: DataFrame, arcs: DataFrame, by: list[str], alphas: list[float], floors: list[float], ks: list[int]) -> DataFrame:
    """For every group (a field f with counts c), persistence threshold, floor and number of regions: captured incidents, nodes and regions."""
    network = spread(arcs)
    if network is None:
        raise ValueError(f"more than {MOST_ARCS} arcs; split the network into districts")
    kept = above_floor(field.where("f > 0"), min(floors), by)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        ids = own["node_id"].to_numpy()
        rows = swept_field(ids, own["f"].to_numpy(), own["c"].to_numpy(), network.value.within(ids), alphas, floors, ks)
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in SWEPT.split(", ")])
        return out.assign(**{c: own[c].iloc[0] for c in by})[[*by, *out.columns]]

    types = dict(field.dtypes)
    return kept.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in by), SWEPT]))


def gathered(counts: DataFrame, by: list[str]) -> DataFrame:
    """A saved row for each group: n (its incidents), nodes and their counts c as arrays."""
    out = counts.groupBy(*by).agg(F.sum("c").cast("long").alias("n"), F.collect_list(F.when(F.col("node_id").isNotNull(), F.struct(F.col("node_id").cast("long").alias("node_id"), F.col("c").cast("long").alias("c")))).alias("own"))
    return storage.saved(out.select(*by, "n", F.col("own.node_id").alias("nodes"), F.col("own.c").alias("c")), "gathered")


def swept_fields(groups: DataFrame, distances, arcs: DataFrame, by: list[str], sigmas: list[float], truncate: float, alphas: list[float], floors: list[float], ks: list[int]) -> DataFrame | None:
    """``swept`` of the fields of each of ``gathered``'s groups and each sigma, with ``by`` and sigma: a field is made and swept in one task's arrays, so that no row per node is. Kernel and network are broadcasts of
    checked size; None if one of them is larger."""
    kernel = spread_pairs(distances)
    network = spread(arcs)
    if kernel is None or network is None:
        return None
    columns = [*by, "sigma", *(x.split()[0] for x in SWEPT.split(", "))]

    def run(frames):
        near, inner = kernel.value.settled(), network.value
        net = near.network
        where = inner.places(net.ids)
        for frame in frames:
            for own in frame.to_dict("records"):
                at = net.places(own["nodes"])
                counts = np.bincount(at[at >= 0], own["c"][at >= 0], len(net.ids))
                field = near.field(counts, near.weights(own["sigma"], truncate * own["sigma"]))
                kept = np.flatnonzero((field > 0) & (field >= min(floors) * field.max(initial=0.0)))
                if len(kept):
                    rows = swept_field(net.ids[kept], field[kept], counts[kept], inner.among(where[kept]), alphas, floors, ks)
                    yield pd.DataFrame([(*(own[c] for c in by), own["sigma"], *r) for r in rows], columns=columns)

    points = groups.select(*by, F.explode(F.array(*[F.lit(float(x)) for x in sigmas])).alias("sigma"))
    each = groups.select(*by, "nodes", "c").join(points.hint("merge"), by)
    dealt = each.repartition(max(1, -(-points.count() // 2)), *by, "sigma")
    types = dict(groups.dtypes)
    return dealt.mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in by), "sigma double", SWEPT]))


def arcs_within(nodes: DataFrame, arcs: DataFrame, by: list[str]) -> DataFrame:
    """Arcs with both ends among a group's nodes."""
    ends = nodes.select(*by, F.col("node_id").alias("src"))
    return ends.join(arcs.select("src", "dst"), "src").join(nodes.select(*by, F.col("node_id").alias("dst")), [*by, "dst"]).select(*by, "src", "dst")


def segment(field: DataFrame, arcs: DataFrame, by: list[str], alpha: float | list[float], floor: float | str, deal: list[str] | None = None) -> DataFrame:
    """Regions of each group's field: by..., peak, node_id, persistence, peak_f. With a list of alphas each row also has its alpha, and a group is read once for all. ``floor`` may
    be one of the group's columns; ``deal`` are columns whose rows are one task's work, if that is more than one group."""
    kept = above_floor(field.where("f > 0"), floor, by).select(*by, "node_id", "f", *[c for c in deal or () if c not in by])
    alphas = alpha if isinstance(alpha, list) else [alpha]
    many = ["alpha"] if isinstance(alpha, list) else []
    columns = [*by, *many, *(x.split()[0] for x in REGION.split(", "))]
    types = dict(field.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), *(f"{c} double" for c in many), REGION])

    def of_group(own: pd.DataFrame, arcs_of) -> list[pd.DataFrame]:
        ids, heights = own["node_id"].to_numpy(), own["f"].round(9).to_numpy()
        found = partitioned(ids, heights, *arcs_of(ids), [a * heights.max() for a in alphas])
        return [x.assign(**{c: own[c].iloc[0] for c in by}, **dict.fromkeys(many, a))[columns] for x, a in zip(found, alphas)]

    network = spread(arcs)
    if network is not None:

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([x for _, own in rows.groupby(by, sort=False) for x in of_group(own, network.value.within)])

        return kept.groupBy(*(deal or by)).applyInPandas(run, schema)

    def cogrouped(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=columns)
        own = own.sort_values("node_id")
        places = lambda ids: tuple(np.searchsorted(ids, pairs[c].to_numpy()) for c in ("src", "dst"))
        return pd.concat(of_group(own, places))

    pairs = arcs_within(kept, arcs, by).select(*[F.col(c).alias(f"__{c}") for c in by], "src", "dst")
    return kept.groupBy(*by).cogroup(pairs.groupBy(*[f"__{c}" for c in by])).applyInPandas(cogrouped, schema)


def hotspots(regions: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """One row per region with incidents: rank, score, nodes, density, seed; ranked by score, then peak height, then peak."""
    joined = regions.join(counts.hint("merge"), [*by, "node_id"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    scored = joined.groupBy(*by, "peak").agg(
        F.sum("c").cast("long").alias("score"),
        F.count("*").alias("n_nodes"),
        F.first("persistence").alias("persistence"),
        F.first("peak_f").alias("peak_f"),
        F.max_by("node_id", F.struct("c", "f", -F.col("node_id"))).alias("seed_node"),
        F.sort_array(F.collect_list("node_id")).alias("nodes"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("peak_f"), "peak")
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("density", F.col("score") / F.col("n_nodes"))


def by_hops(count: dict[int, float]):
    """Growth in breadth: what was found first goes first."""
    return lambda node, found: found


def by_count(count: dict[int, float]):
    """Greedy growth: the node with most incidents first, the smaller id among equals."""
    return lambda node, found: (-count.get(node, 0.0), node)


#: Ways of growing a region, by name.
GROWTH = {"bfs": by_hops, "greedy": by_count}


def grow(seed: int, budget: int, near, taken: set[int], key) -> list[int]:
    """A region of up to ``budget`` nodes: of the free nodes next to it the one with the least key joins, until there is none. ``taken`` gets its nodes."""
    border, found, out = {seed: 0}, {seed}, []
    while border and len(out) < budget:
        node = min(border, key=lambda v: key(v, border[v]))
        del border[node]
        out.append(node)
        taken.add(node)
        for other in near(node):
            if other not in found and other not in taken:
                found.add(other)
                border[other] = len(found)
    return out


def grown(counts: DataFrame, arcs: DataFrame | Spread, by: list[str], regions: int | str, budget: int | str, growth: str = "greedy") -> DataFrame:
    """Regions grown from the nodes with most incidents, one after the other: by..., rank, node_id, c; ranked by incidents. ``regions`` and ``budget`` (nodes of a
    region) may be columns of the groups.

    The network, which ``spread`` may have made for several growths, is a broadcast of checked size; beyond MOST_ARCS it has to be split into districts, and growing is refused."""
    network = arcs if isinstance(arcs, Spread) else spread(arcs)
    if network is None:
        raise ValueError(f"more than {MOST_ARCS} arcs; split the network into districts")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["c", "node_id"], ascending=[False, True])
        most, size = (int(frame[x].iloc[0]) if isinstance(x, str) else x for x in (regions, budget))
        count = dict(zip(frame["node_id"].tolist(), frame["c"].tolist()))
        key, taken, found = GROWTH[growth](count), set(), []
        for seed, c in count.items():
            if len(found) == most or c <= 0:
                break
            if seed not in taken:
                found.append(grow(seed, size, network.value.near, taken, key))
        found.sort(key=lambda r: -sum(count.get(v, 0) for v in r))
        rows = [(k, v, int(count.get(v, 0))) for k, r in enumerate(found, 1) for v in r]
        out = pd.DataFrame(rows, columns=["rank", "node_id", "c"])
        return out.assign(**{c: frame[c].iloc[0] for c in by})[[*by, "rank", "node_id", "c"]]

    types = dict(counts.dtypes)
    return counts.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in by), "rank int, node_id long, c long"]))


def null_counts(counts: DataFrame, nodes: DataFrame, by: list[str], replicates: int, seed: int, permute: bool = False) -> DataFrame:
    """Counts of each replicate under the null: every incident on a node drawn by hash, or the observed counts dealt anew to the active nodes.

    Each draw depends on (seed, group, replicate, number) alone, so results don't depend on partitions. ``nodes`` has node_id and its dense index idx.
    """
    turns = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    if permute:
        drawn = counts.withColumn("replicate", turns)
        own = Window.partitionBy(*by, "replicate")
        drawn = drawn.withColumn("i", F.row_number().over(own.orderBy("node_id"))).withColumn("j", F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed), *by, "replicate", "node_id"), "node_id")))
        values = drawn.select(*by, "replicate", F.col("j").alias("i"), F.col("c").alias("c2"))
        return drawn.join(values, [*by, "replicate", "i"]).select(*by, "replicate", "node_id", F.col("c2").alias("c"))
    size = nodes.count()
    each = counts.groupBy(*by).agg(F.sum("c").cast("int").alias("n")).withColumn("replicate", turns).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    drawn = each.withColumn("idx", F.pmod(F.xxhash64(F.lit(seed), *by, "replicate", "k"), F.lit(size)))
    return drawn.join(nodes.select("idx", "node_id"), "idx").groupBy(*by, "replicate", "node_id").agg(F.count("*").alias("c"))


def hashed(seeds: np.ndarray, n: int) -> np.ndarray:
    """Spark's xxhash64 of the numbers 1 to n, after columns whose hash is the seed."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    shift = [np.uint64(x) for x in (23, 41, 33, 29, 32)]
    h = (np.uint64(np.int64(seeds).view(np.uint64)) + p[3] + np.uint64(4)) ^ (np.arange(1, n + 1, dtype=np.uint64) * p[0])
    h = ((h << shift[0]) | (h >> shift[1])) * p[1] + p[2]
    h = (h ^ (h >> shift[2])) * p[1]
    h = (h ^ (h >> shift[3])) * p[2]
    return (h ^ (h >> shift[4])).view(np.int64)


def highest(field: np.ndarray, counts: np.ndarray, ids: np.ndarray, among, total: int, size: int, alpha: float, floor: float) -> float | None:
    """The highest log likelihood ratio of a field's regions with incidents; None if there are none. ``field`` and ``counts`` are those of ``ids``; ``among`` gives the arcs among places."""
    at = np.flatnonzero((field > 0) & (field >= floor * field.max(initial=0.0)))
    if not len(at):
        return None
    heights = field[at].round(9)
    forest = Forest(ids[at], heights, *among(at))
    nodes, score = forest.sums(alpha * heights.max(), [len(at)], counts[at][forest.order])[0]
    score, nodes = score[score > 0], nodes[score > 0]
    if not len(score):
        return None
    expected = total * nodes / size
    rest, out = total - score, np.zeros(len(score))
    some = (score > expected) & (rest > 0) & (expected > 0)
    a, b, c, d = score[some], expected[some], rest[some], total - expected[some]
    out[some] = a * np.log(a / b) + c * np.log(c / d)
    return float(out.max())


def null_highest(counts: DataFrame, nodes: DataFrame, arcs: DataFrame, distances, by: list[str], replicates: int, seed: int, sigma: float, alpha: float, floor: float) -> DataFrame | None:
    """by..., replicate, value, n_total: the highest log likelihood ratio among the regions of each replicate, drawn as ``null_counts`` draws without ``permute``. A replicate is drawn, diffused and swept in one task's
    arrays, so no row per node leaves it. The network, the kernel and the nodes by index are broadcasts of checked size; None if one has more than MOST_ARCS (the kernel: MOST_PAIRS) rows."""
    spark, network = counts.sparkSession, spread(arcs)
    size = nodes.count()
    kernel = spread_pairs(distances) if network is not None and size <= MOST_ARCS else None
    if kernel is None:
        return None
    named = spark.sparkContext.broadcast(packed(nodes.select(F.col("idx").cast("long").alias("src"), F.col("node_id").alias("dst"))))

    def run(frames):
        near, weights = kernel.value.settled().network, kernel.value.weights(sigma)
        names, n = named.value.network, len(near.ids)
        where, inner = network.value.places(near.ids), network.value
        at = names.places(np.arange(size))
        named_ = (at >= 0) & (names.start[at + 1] > names.start[at])
        spot = np.where(named_, near.places(names.ids[names.to[np.where(named_, names.start[at], 0)]]), -2)  # -1: without an arc, -2: no such index
        for frame in frames:
            found, totals = [], []
            for total, key in zip(frame["n_total"].tolist(), frame["__h"].tolist()):
                drawn = spot[hashed(np.int64(key), total) % size]
                totals.append(total := int((drawn > -2).sum()))
                own = np.bincount(drawn[drawn >= 0], minlength=n)
                found.append(highest(kernel.value.field(own, weights), own, near.ids, lambda at: inner.among(where[at]), total, size, alpha, floor))
            out = frame.assign(value=np.array(found, "float64"), n_total=totals)
            yield out.loc[out["value"].notna(), [*by, "replicate", "value", "n_total"]]

    total = counts.groupBy(*by).agg(F.sum("c").cast("long").alias("n_total"))
    rows = total.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("__h", F.xxhash64(F.lit(seed), *by, "replicate"))
    dealt = rows.repartition(max(1, -(-rows.count() // 32)), *by, "replicate")
    types = dict(counts.dtypes)
    return dealt.mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in by), "replicate int, value double, n_total long"]))
