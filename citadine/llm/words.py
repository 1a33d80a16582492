"""Words, their hashes and n-grams, straight from Arrow's UTF-8 buffers with numpy.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR; as
those are ASCII, byte runs and code point runs are the same. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)
BASE = U64(0x9E3779B97F4A7C15)
PIECE_BYTES = 2 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(byte_lengths(batch.column(column)))
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_lengths(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    return np.diff(offsets.astype(np.int64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null texts have no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each document's first word (one entry more than documents)."""
    solid = ~gaps[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, eight bytes at a time."""
    left = ends - starts
    out = left.astype(U64) * BASE
    if not len(out):
        return out
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    live, at = np.arange(len(out)), starts
    while len(live):
        lanes = windows[at].view("<u8").ravel() & MASKS[np.minimum(left, 8)]
        out[live] = mixed(out[live] ^ lanes)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries, by doubling; the result is ``k - 1`` entries shorter."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    done, have, size, power = None, 0, 1, hashes
    while True:
        if k & size:
            if done is None:
                done = power
            else:
                n = len(hashes) - (have + size) + 1
                done = power[:n] * _power(have) + done[size : size + n]
            have += size
        if have == k:
            return mixed(done)
        power = power[:-size] * _power(size) + power[size:]
        size *= 2


def _power(n: int) -> np.uint64:
    return U64(pow(int(BASE), n, 1 << 64))


def document_of(firsts: np.ndarray) -> np.ndarray:
    """For every word the index of its document."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key is found more than once among ``keys``."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` entries lie in a window of ``length`` entries that begins at one of ``starts``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (without the line feed) of every line and its document; an empty text is one empty line."""
    feeds = np.flatnonzero(raw == 10)
    owner = np.searchsorted(offsets[1:], feeds, side="right")
    starts = np.concatenate([offsets[:-1], feeds + 1])
    ends = np.concatenate([feeds, offsets[1:]])
    owners = np.concatenate([np.arange(len(offsets) - 1), owner])
    order = np.lexsort((starts, owners))
    ends_owner = np.concatenate([owner, np.arange(len(offsets) - 1)])
    return starts[order], ends[np.lexsort((ends, ends_owner))], owners[order]


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
