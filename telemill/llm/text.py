"""Vectorised text helpers shared by the operators of this subpackage.

An Arrow string column is looked at as one byte buffer with document offsets,
cut into slices of a bounded number of bytes, so that every temporary array is
bounded too. Hashes of words and lines mix eight bytes at a time; hashes of
windows of a fixed number of bytes or words are differences of polynomial prefix
sums over 2**64, finished by a 64-bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that end a word: space and tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) (or of its inverse), kept for the worker."""
    name = "inv" if inverse else "pow"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, _INV if inverse else _BASE, dtype=np.uint64)
        out[0] = 1
        have = _powers[name] = np.cumprod(out)
    return have[:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64, count=n + 1 + column.offset)[column.offset:]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and the words' offsets by document."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~IS_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    start = np.flatnonzero(w & (first[:n] | np.concatenate(([True], ~w[:-1]))))
    end = np.flatnonzero(w & (first[1:] | np.concatenate((~w[1:], [True])))) + 1
    return start, end, np.searchsorted(start, off, side="left")


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with sum(a, b) = (c[b] - c[a]) * inverse power a."""
    c = np.empty(len(data) + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum(_TABLE[data] * powers(len(data)), out=c[1:])
    return c


#: Spans of up to so many bytes are hashed together, eight bytes at a time; longer ones one by one.
SHORT_SPAN = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans. Each eight bytes go through a mixer: sums of powers, as the windows below have
    them, collide on long spans of a regular make."""
    start, length = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    h = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)
    if not len(start):
        return h
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    live, at = np.flatnonzero((length > 0) & (length <= SHORT_SPAN)), 0
    while len(live):
        left = length[live] - at
        x = eight[start[live] + at] & _KEEP[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ (x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at + 1)))
        live, at = live[left > 8], at + 8
    long = np.flatnonzero(length > SHORT_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:x + n]) for x, n in zip(start[long].tolist(), length[long].tolist(), strict=True)),
                              np.uint64, len(long))
    return mix(h)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive values that start at each place (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = np.empty(len(h) + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum(h * powers(len(h)), out=c[1:])
    return mix((c[k:] - c[:-k]) * powers(n, inverse=True))


def byte_window_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes that start at each place (len(data) - k + 1 of them)."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = prefix_hash(data)
    return mix((c[k:] - c[:-k]) * powers(n, inverse=True))


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of the w values from each place (len(h) - w + 1 of them), by doubling."""
    have, out = 1, h
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[:len(out) - (w - have)], out[w - have:])
    return out


def places_in_documents(off: np.ndarray, need: int) -> np.ndarray:
    """Places from which `need` values lie inside one document, for documents with offsets off."""
    n = int(off[-1])
    if n == 0:
        return np.zeros(0, np.int64)
    length = np.diff(off)
    room = np.repeat(off[1:], length) - np.arange(n)
    return np.flatnonzero(room >= need)
