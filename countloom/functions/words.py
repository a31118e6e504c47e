"""Counts of words in Arrow batches, without an object a word.

Words are runs of certain ASCII letters in texts whose ASCII letters are made small. For
``DataFrame.mapInArrow``: the functions take and give batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and cells, of a block; a longer text is a block of its own.
STEP, CELLS = 4 << 20, 1 << 18
#: A block: rows and how many cells each has; of the cells, as packed integers, the places of their terms among the block's own, and the counts; these terms, and in how many rows each is.
BLOCK = "sample_id array<string>, i array<bigint>, sizes array<int>, codes binary, vs binary, terms array<string>, documents array<bigint>"
#: Rows with their cells as packed integers; the terms that have no number yet, and their counts.
FOUND = "sample_id string, i bigint, n bigint, gs binary, vs binary, terms array<string>, counts array<bigint>"


def letters(word: str) -> np.ndarray | None:
    """Which bytes are letters, where ``word`` is a class of ASCII letters, digits and ranges of them, once or more; None where it is another expression."""
    if not re.fullmatch(r"\[(?:[a-z]-[a-z]|[0-9]-[0-9]|[a-z0-9_])+\]\+", word):
        return None
    one = re.compile(word.encode())
    return np.array([one.fullmatch(bytes([c])) is not None for c in range(256)])


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _packed(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """So many of the values for each row, as their bytes."""
    at = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all rows of ``_packed``, one after the other."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind, (at[-1] - at[0]) // np.dtype(kind).itemsize, at[0]) if at[-1] > at[0] else np.empty(0, kind)


def _steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of ``most`` in all, or of one larger row."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), "right")))
        yield lo, hi
        lo = hi


def count_words(text: pa.Array, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(how many words each text has that differ; their places among all, by text; how often each is in the text; all words, once)."""
    n, small = len(text), np.arange(256, dtype=np.uint8)
    small[65:91] += 32
    _, at, data = text.buffers()
    at = np.frombuffer(at, np.int32)[text.offset : text.offset + n + 1]
    data = small[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    inside = letter[data]
    # A word ends where its text does.
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    apart = ~(inside[1:] & inside[:-1]) | edge[1:-1] if len(data) else np.empty(0, bool)
    first, last = inside.copy(), inside.copy()
    first[1:] &= apart
    last[:-1] &= apart
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[inside])).dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    key, held = np.unique((np.searchsorted(at[:-1], first, "right") - 1) * kinds + coded.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(key, kinds)
    return np.bincount(row, minlength=n), code, held, coded.dictionary


def _block(sample: pa.Array, i: pa.Array, sizes: np.ndarray, codes: np.ndarray, vs: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    documents, whole = pa.array(np.bincount(codes, minlength=len(terms)), pa.int64()), np.array([len(codes)])
    one = lambda c: _lists(np.array([len(c)]), c)
    columns = [one(sample), one(i), one(pa.array(sizes, pa.int32())), _packed(whole, codes.astype(np.int32)), _packed(whole, vs.astype(np.int64)), one(terms), one(documents)]
    return pa.RecordBatch.from_arrays(columns, ["sample_id", "i", "sizes", "codes", "vs", "terms", "documents"])


def counter(word: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sample_id, i, text) to blocks."""
    letter = letters(word)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _steps(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), STEP):
                part = b.slice(lo, hi - lo)
                sizes, codes, held, terms = count_words(part.column("text"), letter)
                yield _block(part.column("sample_id"), part.column("i"), sizes, codes, held, terms)

    return count


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sample_id, i, term, v), each cell once, to blocks."""

    def pieces() -> Iterator[pa.Table]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            waiting.append(b)
            if sum(w.num_rows for w in waiting) >= CELLS:
                yield pa.Table.from_batches(waiting)
                waiting = []
        if waiting:
            yield pa.Table.from_batches(waiting)

    for t in pieces():
        sample, i, term, v = (t.column(c).combine_chunks() for c in ("sample_id", "i", "term", "v"))
        if not len(i):
            continue
        s, k = sample.dictionary_encode().indices.to_numpy(), i.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))
        coded = term.dictionary_encode()
        yield _block(sample.take(pa.array(first)), i.take(pa.array(first)), np.diff(np.append(first, len(i))), coded.indices.to_numpy(), v.to_numpy(), coded.dictionary)


def finder(terms: pa.Array, numbers: np.ndarray, others: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks to rows (``FOUND``): numbers of the known ``terms``, n of them, in order, and, if asked for, the terms that are not known."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sample, i, sizes, own = (b.column(c).flatten() for c in ("sample_id", "i", "sizes", "terms"))
            n, code, held = len(i), _unpacked(b.column("codes"), np.int32), _unpacked(b.column("vs"), np.int64)
            before = np.cumsum(np.concatenate([[0], b.column("terms").value_lengths().to_numpy()]))[:-1]
            term = code + np.repeat(before, pc.binary_length(b.column("codes")).to_numpy() // 4)
            place = pc.fill_null(pc.index_in(own, value_set=terms), -1).to_numpy()[term]
            row = np.repeat(np.arange(n), sizes.to_numpy())
            # Terms are sorted, and so are their numbers.
            order = np.flatnonzero(place >= 0)
            order = order[np.argsort(row[order] * max(1, len(terms)) + place[order])]
            new = np.flatnonzero(place < 0) if others else np.empty(0, np.int64)
            known, rest = np.bincount(row[order], minlength=n), np.bincount(row[new], minlength=n)
            columns = [sample, i, pa.array(known, pa.int64()), _packed(known, numbers[place[order]]), _packed(known, held[order]), _lists(rest, own.take(pa.array(term[new]))), _lists(rest, pa.array(held[new], pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["sample_id", "i", "n", "gs", "vs", "terms", "counts"])

    return find


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., g, v, gs, vs) to (..., gs, vs) with cells as lists: those that are packed, or the one that is not."""
    for b in batches:
        packed = pc.fill_null(pc.binary_length(b.column("gs")), 0).to_numpy() // 8
        own = packed + b.column("g").is_valid().to_numpy(zero_copy_only=False)
        many, out = np.repeat(packed > 0, own), []
        for one, all_ in (("g", "gs"), ("v", "vs")):
            x = np.empty(len(many), np.int64)
            x[many], x[~many] = _unpacked(b.column(all_), np.int64), b.column(one).drop_null().to_numpy()
            out.append(_lists(own, pa.array(x)))
        kept = [c for c in b.schema.names if c not in ("g", "v", "gs", "vs")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *out], [*kept, "gs", "vs"])
