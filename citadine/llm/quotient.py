"""Counting quotient filters.

A fingerprint of ``bits`` bits is parted in a quotient and a remainder. Fingerprints with the same quotient form a run, sorted by remainder. Kept are one bit per
quotient (does it occur?), and per entry one bit (does it end its run?), the remainder in as few bits as it has, and one bit (is it counted
more than once?); counts above one follow as bytes of seven bits each. An entry so takes some ``bits`` - log2(entries) + 3 bits.

Filters merge by walking their entries, which come sorted by fingerprint, whatever the two numbers of quotient bits; nothing is lost, and the order of merges doesn't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64


def varints(values: np.ndarray) -> bytes:
    """Seven bits to a byte, low ones first; the top bit says that another byte follows."""
    rows, rest = [], values.astype(U64)
    live = np.arange(len(rest))
    while len(live):
        more = rest > 127
        rows.append((live, (rest & U64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)))
        live, rest = live[more], rest[more] >> U64(7)
    if not rows:
        return b""
    owner, part = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    return part[np.argsort(owner, kind="stable")].tobytes()


def of_varints(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8)
    if not len(part):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(part < 128)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(part)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((part & 127).astype(U64) << (U64(7) * place.astype(U64)), first).astype(np.int64)


def packed(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    return np.packbits((values[:, None] >> np.arange(width - 1, -1, -1, dtype=U64)).astype(np.uint8) & 1).tobytes()


def unpacked(raw: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, U64)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width).reshape(n, width).astype(U64)
    return (bits << np.arange(width - 1, -1, -1, dtype=U64)).sum(1, dtype=U64)


@dataclass
class Filter:
    bits: int
    quotient_bits: int
    size: int
    occupied: bytes
    run_ends: bytes
    remainders: bytes
    repeated: bytes
    counters: bytes

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> Filter:
        """From distinct sorted fingerprints; there are as many quotients as entries, up to a factor of two."""
        n = len(keys)
        q = min(bits, max(0, n - 1).bit_length())
        width = bits - q
        quotient = (keys >> U64(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        again = counts > 1
        bitmap = lambda x: np.packbits(x).tobytes()
        rest = keys & U64((1 << width) - 1)
        return cls(bits, q, n, bitmap(occupied), bitmap(ends), packed(rest, width), bitmap(again), varints(counts[again] - 2))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order, and their counts."""
        bitmap = lambda raw, n: np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        ends = np.flatnonzero(bitmap(self.run_ends, self.size))
        quotient = np.repeat(np.flatnonzero(bitmap(self.occupied, 1 << self.quotient_bits)), np.diff(ends, prepend=-1))
        width = self.bits - self.quotient_bits
        keys = unpacked(self.remainders, self.size, width)
        if width < 64:
            keys |= quotient.astype(U64) << U64(width)
        counts = np.ones(self.size, np.int64)
        counts[bitmap(self.repeated, self.size)] = of_varints(self.counters) + 2
        return keys, counts

    def merge(self, other: Filter) -> Filter:
        """Walk both: a fingerprint of both adds its counts, one of either goes where it belongs."""
        (x, m), (y, n) = self.entries(), other.entries()
        at = np.searchsorted(x, y)
        known = np.zeros(len(y), bool)
        inside = at < len(x)
        known[inside] = x[at[inside]] == y[inside]
        m = m.copy()
        m[at[known]] += n[known]
        new = ~known
        return Filter.of(np.insert(x, at[new], y[new]), np.insert(m, at[new], n[new]), self.bits)

    def parts(self, bits: int) -> list[tuple[int, Filter]]:
        """A filter for each value of the first ``bits`` bits that occurs, over what follows them."""
        keys, counts = self.entries()
        width = self.bits - bits
        head = keys >> U64(width)
        cuts = np.append(np.flatnonzero(np.append(True, head[1:] != head[:-1])) if len(keys) else [], len(keys)).astype(int)
        low = keys & U64((1 << width) - 1)
        return [(int(head[i]), Filter.of(low[i:j], counts[i:j], width)) for i, j in zip(cuts[:-1], cuts[1:])]


def filled(fingerprints: np.ndarray, bits: int) -> Filter:
    """Of fingerprints in any order, with repeats."""
    keys, counts = np.unique(fingerprints, return_counts=True)
    return Filter.of(keys, counts.astype(np.int64), bits)


def merged(filters: list[Filter]) -> Filter:
    """All in one, two by two, so that each entry is walked as often as the number of filters can be halved."""
    while len(filters) > 1:
        filters = [filters[i].merge(filters[i + 1]) if i + 1 < len(filters) else filters[i] for i in range(0, len(filters), 2)]
    return filters[0]
