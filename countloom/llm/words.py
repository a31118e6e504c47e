"""Words of a column of texts as NumPy arrays: hashes, rows and byte spans.

Texts come as Arrow batches. A word is a maximal run of bytes of a class; both
classes used here are closed under UTF-8 (every byte of a character beyond ASCII
is a word byte), so bytes give the same words as characters do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = 1 << 18

#: Bytes that are not white space: [^\x20\x09-\x0D]
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Digits, a-z (after lower-casing) and all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    hash: np.ndarray  # uint64
    row: np.ndarray  # int64, row of the batch
    start: np.ndarray  # int64, byte offsets in ``data``
    end: np.ndarray
    first: np.ndarray  # int64, len(rows) + 1: words of row r are first[r]:first[r + 1]
    data: np.ndarray  # uint8, lower-cased where asked


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0xD1342543DE82EF95
_PINV = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_tables.get("p", ())) < n:
        m = max(n, _CHUNK * 2)
        for name, base in (("p", _P), ("q", _PINV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["p"], _tables["q"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What operators keep in a worker process between tasks: name, and how to drop it.
_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, drop: Callable[[], None]) -> None:
    _kept[owner] = drop


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, one row at least.

    A worker serves many tasks; what another operator than ``owner`` has kept in it goes.
    """
    for name in [n for n in _kept if n != owner]:
        _kept.pop(name)()
    for b in batches:
        if not b.num_rows:
            continue
        _, offsets = text_buffer(b.column(column))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _CHUNK, "right")))
        s0, e1 = int(start[i]), int(end[j - 1])
        p, q = powers(e1 - s0 + 1)
        c = np.zeros(e1 - s0 + 1, np.uint64)
        np.cumsum(_BYTE[data[s0:e1]] * p[: e1 - s0], out=c[1:])
        out[i:j] = (c[end[i:j] - s0] - c[start[i:j] - s0]) * q[start[i:j] - s0]
        i = j
    return mix(out)


def words(column: pa.Array, kind: np.ndarray = ALNUM, lower: bool = True) -> Words:
    data, offsets = text_buffer(column)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    n = len(data)
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < n]
        starts[edge] |= inside[edge]
        edge = edge[edge > 0] - 1
        ends[edge] |= inside[edge]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(_hashes(data, start, end), row, start, end, first, data)


def word_counts(column: pa.Array, kind: np.ndarray = NON_SPACE) -> np.ndarray:
    """Number of words of each row, without hashing them."""
    data, offsets = text_buffer(column)
    inside = kind[data]
    starts = inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        starts[edge] |= inside[edge]
    total = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``k`` words, in order of position.

    A row of fewer words, but not none, has one shingle of all its words.
    """
    n = len(w.hash)
    counts = np.diff(w.first)
    if n >= k:
        acc = w.hash[: n - k + 1].copy()
        for d in range(1, k):
            acc *= np.uint64(0x9FB21C651E98DF25)
            acc += w.hash[d : n - k + 1 + d]
        ok = w.row[: n - k + 1] == w.row[k - 1 :]
        h, r = mix(acc[ok]), w.row[: n - k + 1][ok]
    else:
        h, r = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for d in range(k - 1):
            has = counts[short] > d
            extra[has] = extra[has] * np.uint64(0x9FB21C651E98DF25) + w.hash[w.first[short[has]] + d]
        h, r = np.concatenate([h, mix(extra ^ np.uint64(0x5851F42D4C957F2D))]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def planes(x: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, as many as the largest needs; these compress well."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.int64)
