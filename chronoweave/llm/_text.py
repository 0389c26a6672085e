"""Vectorised byte kernels over Arrow string columns: words, hashes and windows without per-row Python.

``hashes`` names words, lines and texts: eight bytes at a time go through a 64-bit mixing chain, long
ranges through BLAKE2.  ``range_hash`` is a polynomial prefix hash (mod 2**64) whose value for any byte
range costs O(1); its structure allows collisions of long ranges, so it only picks and filters windows.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word separators: space and 0x09-0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For word features: every ASCII byte but letters, digits and the apostrophe separates as well.
PUNCT = np.array([c < 128 and not chr(c).isalnum() and c != 39 for c in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse.  They outlive a task in a module of their own, as this
    module travels with the tasks and is a new one in each."""
    _pow = sys.modules.setdefault("_chronoweave_powers", ModuleType("_chronoweave_powers")).__dict__
    if "b" not in _pow or len(_pow["b"]) < n:
        for k, base in (("b", _BASE), ("i", _INV)):
            p = np.full(max(n, 1 << 16), _U(base))
            p[0] = 1
            np.cumprod(p, out=p)
            _pow[k] = p
    return _pow["b"][:n], _pow["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix(buf: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of codes[buf[t]] * B**t over i <= t < j."""
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODES[buf] * _powers(len(buf))[0], out=c[1:])
    return c


def range_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, independent of where they lie."""
    inv = _powers(len(c))[1]
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


#: Ranges beyond this many bytes are hashed by BLAKE2.
LANES = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by their content alone."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _U(_BASE) + _U(0x5851F42D4C957F2D))
    if not len(size) or not len(buf):
        return out
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each position on
    at = np.flatnonzero((size > 0) & (size <= LANES))
    done = 0
    while len(at):
        part = lanes[starts[at] + done] & _MASK[np.minimum(size[at] - done, 8)]
        out[at] = mix((out[at] ^ part) * _U(0xD6E8FEB86659FD93) + _U(done + 1))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LANES).tolist():
        digest = hashlib.blake2b(buf[starts[i]: ends[i]].tobytes(), digest_size=8).digest()
        out[i] = _U(int.from_bytes(digest, "little"))
    return out


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and the n + 1 row offsets into them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.dtype(np.int64 if wide else np.int32)
    o = np.frombuffer(off, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    if data is None or o[-1] <= o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8, int(o[-1] - o[0]), int(o[0])), o - o[0]


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; Arrow's pool gives back what it freed, as reused workers would hold on to it."""
    pool = pa.default_memory_pool()
    for b in batches:
        pool.release_unused()
        yield b
        del b
    pool.release_unused()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text at most (or one longer row)."""
    for b in released(batches):
        if not b.num_rows:
            continue
        o = texts(b.column(b.schema.get_field_index(column)))[1]
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def words(buf: np.ndarray, rows: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word's index for each row (n + 1 entries)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(rows), np.int64)
    gap = space[buf]
    solid = ~gap
    edge = np.zeros(len(buf) + 1, bool)
    edge[rows] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid
    last[:-1] &= gap[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, rows)


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def grams(h: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within rows, and the row of each; with ``short``, a row of fewer
    words (one at least) gives its whole sequence as one."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    at = np.arange(len(h))
    keep = at + n <= np.repeat(first[1:], count)
    at = at[keep]
    g = np.full(len(at), _U(n))
    for j in range(n):
        g = (g + h[at + j]) * _U(0xD6E8FEB86659FD93)
        g ^= g >> _U(32)
    if short and ((count > 0) & (count < n)).any():
        few = np.flatnonzero((count > 0) & (count < n))
        extra = []
        for r in few:
            x = 0xABCDEF ^ int(count[r])
            for v in h[first[r]: first[r + 1]].tolist():
                x = ((x + v) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
                x ^= x >> 32
            extra.append(x)
        g, row = np.concatenate([g, np.array(extra, np.uint64)]), np.concatenate([row, few])
    return mix(g), row


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal values in a sorted array."""
    at = starts_of(keys).tolist()
    return list(zip(at, [*at[1:], len(keys)][: len(at)], strict=True))
