"""Keys with the places that hold them, dealt into groups: which places hold a key that is found more than once?

Mappers collect (key, document, position) for some megabytes of text, settle the keys that they already hold twice themselves, and
send each other key, with its place, to its group; of a settled key only one witness without a place goes there. So however often a
key is found, its group gets at most one entry from each such batch. Places travel as packed arrays: document, number of entries, positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

DEALT = "bucket long, settled boolean, keys binary, docs binary, tags binary, counts binary, pos binary"
PLACES = "kind int, d long, t int, pos binary"
U32 = np.uint32


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal entries begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def twice(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For each key (hi, lo): 0 if it is alone, 1 for the first of equal keys, 2 for the others."""
    order = np.lexsort((lo, hi)) if lo.any() else np.argsort(hi, kind="stable")
    a, b = hi[order], lo[order]
    same = np.zeros(len(hi) + 1, bool)
    same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out = np.zeros(len(hi), np.int8)
    out[order] = np.where(same[:-1], 2, np.where(same[1:], 1, 0))
    return out


class Dealer:
    """Collects entries of a mapper and gives them away as rows of DEALT."""

    def __init__(self, groups: int, group_of: Callable[..., np.ndarray], limit: int = 400_000, keep_keys: bool = False):
        self.groups, self.group_of, self.limit, self.keep_keys = groups, group_of, limit, keep_keys
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = self.given = 0

    def add(self, hi, lo, d, t, pos, *hints) -> Iterator[pa.RecordBatch]:
        if len(hi):
            self.held.append((hi, lo, d, t, pos.astype(U32), *hints))
            self.n += len(hi)
        if self.n >= self.limit:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        hi, lo, d, t, pos, *hints = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        if self.keep_keys:  # a document of several pieces that holds a key, such as equal groups, counts once
            order = np.lexsort((t, d, hi))
            once = np.sort(order[runs_of(hi[order], d[order], t[order])])
            hi, lo, d, t, pos, *hints = (x[once] for x in (hi, lo, d, t, pos, *hints))
        state = twice(hi, lo)
        rows: list[tuple] = []
        settled = state > 0
        if settled.any():
            keys = hi[settled].tobytes() + lo[settled].astype(U32).tobytes() if self.keep_keys else b""
            rows.append((self.groups + self.given % self.groups, True, keys, *packed(d[settled], t[settled], pos[settled])))
        self.given += 1
        alone, witness = np.flatnonzero(state == 0), np.flatnonzero(state == 1)
        at = np.concatenate([alone, witness])
        located = np.arange(len(at)) < len(alone)
        group = self.group_of(hi[at], *(h[at] for h in hints))
        order = np.argsort(group, kind="stable")  # within a group places come first, in the order of documents
        at, located, group = at[order], located[order], group[order]
        starts = runs_of(group)
        for i, j in zip(starts, np.append(starts[1:], len(group))):
            own, here = at[i:j], at[i:j][located[i:j]]
            rows.append((int(group[i]), False, hi[own].tobytes() + lo[own].astype(U32).tobytes(), *packed(d[here], t[here], pos[here])))
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in DEALT.split(", ")])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield self.flush()


def packed(d: np.ndarray, t: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Documents, their tags and numbers of entries, and for each document its first position and the steps to the next ones."""
    head = runs_of(d, t)
    step = pos.astype(np.int64)
    step[1:] -= pos[:-1].astype(np.int64)
    step[head] = pos[head]
    return d[head].tobytes(), t[head].tobytes(), np.diff(np.append(head, len(d))).astype(U32).tobytes(), step.astype(np.int32).tobytes()


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.frombuffer(row["counts"], U32).astype(np.int64)
    step = np.frombuffer(row["pos"], np.int32).astype(np.int64)
    total = np.cumsum(step)
    starts = np.cumsum(counts) - counts
    pos = total - np.repeat(total[starts] - step[starts], counts) if len(step) else step
    return np.repeat(np.frombuffer(row["docs"], np.int64), counts), np.repeat(np.frombuffer(row["tags"], np.int32), counts), pos


def places(d: np.ndarray, t: np.ndarray, pos: np.ndarray) -> pa.Table:
    """Rows of PLACES: one per run of entries of a document."""
    head = runs_of(d, t)
    offsets = np.append(head, len(d)).astype(np.int32) * 4
    blobs = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pos.astype(U32).tobytes())])
    return pa.table({"kind": pa.array(np.zeros(len(head), np.int32)), "d": pa.array(d[head]), "t": pa.array(t[head]), "pos": blobs})


def repeated_places(dealt: pa.Table) -> pa.Table:
    """The places of one group whose key is found more than once, and those that were settled before."""
    hi, lo, located, d, t, pos, outs = [], [], [], [], [], [], []
    for row in dealt.to_pylist():
        found = unpacked(row)
        if row["settled"]:
            outs.append(places(*found))
            continue
        n = len(row["keys"]) // 12
        hi.append(np.frombuffer(row["keys"], np.uint64, n))
        lo.append(np.frombuffer(row["keys"], U32, n, 8 * n))
        located.append(np.arange(n) < len(found[0]))
        for to, x in zip((d, t, pos), found):
            to.append(x)
    if hi:
        mark = np.concatenate(located)
        again = (twice(np.concatenate(hi), np.concatenate(lo)) > 0)[mark]
        outs.append(places(*(np.concatenate(x)[again] for x in (d, t, pos))))
    return pa.concat_tables(outs)
