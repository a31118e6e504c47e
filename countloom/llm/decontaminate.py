"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (13 consecutive words, or the whole of a shorter item)
is a set to be contained exactly, so its prefix is one word: its rarest. A
document is looked up by its words among those prefixes only; a candidate must
leave room for the words before and after (positional and length bounds), and is
then compared as a whole, first by hash and at last as bytes. Windows that share a
prefix word cost no more than the places that it has in them, so neither a
common prefix nor a long text takes more memory or time than its words do.

The index is made by tasks, in blocks of about ``block_words`` window words each, in
the shared folder; the driver sees their names and sizes. A task keeps blocks of
at most CACHE bytes at hand; where there are more, it goes through all of them once
for every CHUNK bytes of documents. So no task holds more than these two, however
large the benchmark is. Documents are read once and not shuffled.

Defined cases: a null or word-less text has no words and is never contaminated;
repeated document rows each get their row; a null item_id takes part in hits and
is not named; repeated item_ids count once; an empty benchmark hits nothing.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import attempt_name, fresh_path, read_bytes, write_bytes
from .words import ALNUM, mix, pieces, powers, words

WINDOW = 13
#: Bytes of blocks that a task keeps, and of texts that it holds against blocks it cannot keep.
CACHE, CHUNK = 256 << 20, 32 << 20
#: Places looked at in one step.
STEP = 1 << 20
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"


def _block(items: list[tuple[str | None, list[bytes]]], window: int) -> bytes:
    """One block of the index. items: id as text, words."""
    seen = Counter(w for _, ws in items for w in set(ws))
    wins: dict[tuple[bytes, ...], set[str]] = {}
    for name, ws in items:
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1):
            wins.setdefault(tuple(ws[i : i + size]), set()).update([name] if name is not None else [])
    keys = list(wins)
    flat = pa.array([w.decode("utf-8", "surrogateescape") for k in keys for w in k], pa.large_string()) if keys else pa.array([], pa.large_string())
    hashes = words(flat, ALNUM).hash
    sizes = np.array([len(k) for k in keys], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    rare = np.array([min(range(len(k)), key=lambda j: (seen[k[j]], -len(k[j]), k[j])) for k in keys], np.int64)
    p, _ = powers(window)
    total = np.zeros(len(keys), np.uint64)
    for d in range(window):
        has = sizes > d
        total[has] += hashes[at[:-1][has] + d] * p[d]
    key = _finish(total, sizes)
    places = np.unique(np.rec.fromarrays([hashes[at[:-1] + rare], rare, sizes], names="prefix,rare,long")) if len(keys) else np.rec.fromarrays([np.empty(0, np.uint64), rare, sizes], names="prefix,rare,long")
    order = np.argsort(key, kind="stable")
    names = sorted({n for v in wins.values() for n in v})
    number = {n: i for i, n in enumerate(names)}
    members = [sorted(number[n] for n in wins[keys[i]]) for i in order]
    texts = [b" ".join(keys[i]) for i in order]
    named = [n.encode("utf-8", "surrogateescape") for n in names]
    out = io.BytesIO()
    np.savez(
        out, prefix=places["prefix"], rare=places["rare"], long=places["long"], key=key[order], size=sizes[order], **_strings("text", texts), **_strings("name", named),
        members=np.array([m for x in members for m in x], np.int64), first=np.concatenate([[0], np.cumsum([len(x) for x in members])]).astype(np.int64),
    )
    return out.getvalue()


def _finish(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Key of a stretch from the sum of its words' hashes by position, and its length."""
    return mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _strings(name: str, values: list[bytes]) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(b"".join(values), np.uint8), f"{name}_at": np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)}


def build_index(benchmark: DataFrame, window: int = WINDOW, block_words: int = 2_000_000) -> list[tuple[str, int]]:
    """Write the index; returns (URI, bytes in memory) of its blocks.

    Items are dealt out by a hash; a task closes a block once it is large enough.
    """
    base = fresh_path(benchmark.sparkSession, "windows")
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    # A word is some five characters, and stands in a window's number of windows.
    parts = int(min(10_000, 1 + size * window // (5 * block_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words_ = [], 0

        def flush() -> pa.RecordBatch:
            raw = _block(held, window)
            uri = f"{base}/{attempt_name(TaskContext.get().partitionId())}.npz"
            write_bytes(uri, raw)
            held.clear()
            return pa.RecordBatch.from_pydict({"uri": [uri], "bytes": [len(raw)]})

        for b in pieces(batches, "text"):
            w = words(b.column("text"), ALNUM)
            for r, name in enumerate(b.column("name").to_pylist()):
                lo, hi = w.first[r], w.first[r + 1]
                if hi > lo:
                    held.append((name, [w.data[s:e].tobytes() for s, e in zip(w.start[lo:hi], w.end[lo:hi], strict=True)]))
                    words_ += int(hi - lo) * window
                if words_ >= block_words:
                    yield flush()
                    words_ = 0
        if held:
            yield flush()

    return [(r["uri"], r["bytes"]) for r in items.repartition(parts, F.xxhash64("text")).mapInArrow(run, "uri string, bytes bigint").orderBy("uri").collect()]


_held: OrderedDict[str, dict] = OrderedDict()


def _load(uri: str) -> dict:
    """A block; the longest unused go where they are too many."""
    if uri not in _held:
        with np.load(io.BytesIO(read_bytes(uri))) as z:
            _held[uri] = {k: z[k] for k in z.files}
    _held.move_to_end(uri)
    size = lambda x: sum(v.nbytes for v in x.values())
    while len(_held) > 1 and sum(map(size, _held.values())) > CACHE:
        _held.popitem(last=False)
    return _held[uri]


def _occurrences(w, x: dict) -> tuple[np.ndarray, np.ndarray]:
    """First words and window numbers of all occurrences of a block's windows.

    A prefix word stands for its places (position in the window, window's size), of
    which there are at most window * (window + 1) / 2, however many windows share it. A place
    leaves one stretch of the document, whose hash finds the windows it can be.
    """
    lo, hi = np.searchsorted(x["prefix"], w.hash, "left"), np.searchsorted(x["prefix"], w.hash, "right")
    hit = np.flatnonzero(hi > lo)
    n = (hi - lo)[hit]
    upto = np.cumsum(n)
    p, q = powers(len(w.hash) + 1)
    sums = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * p[: len(w.hash)], out=sums[1:])
    found_s, found_v, a = [], [], 0
    while a < len(hit):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STEP, "right")))
        m = n[a:b]
        place = np.repeat(lo[hit[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        at = np.repeat(hit[a:b], m)
        s, size, row = at - x["rare"][place], x["long"][place], w.row[at]
        ok = (s >= w.first[row]) & (s + size <= w.first[row + 1])
        s, size = s[ok], size[ok]
        key = _finish((sums[s + size] - sums[s]) * q[s], size)
        first, last = np.searchsorted(x["key"], key, "left"), np.searchsorted(x["key"], key, "right")
        # Windows of a block differ, so more than one of a key is a clash of hashes.
        m = last - first
        s, win = np.repeat(s, m), np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())
        text, ends = x["text"], x["text_at"]
        same = [b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(i, i + k)) == text[ends[v] : ends[v + 1]].tobytes() for i, k, v in zip(s, x["size"][win], win, strict=True)]
        same = np.array(same, bool)
        found_s.append(s[same])
        found_v.append(win[same])
        a = b
    return (np.concatenate(found_s), np.concatenate(found_v)) if found_s else (np.empty(0, np.int64), np.empty(0, np.int64))


class _Hits:
    """The words of some rows, which of them are hit, and the items by row."""

    def __init__(self, b: pa.RecordBatch):
        self.batch, self.w = b, words(b.column("text"), ALNUM)
        self.edges = np.zeros(len(self.w.hash) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(b.num_rows)]

    def look(self, x: dict) -> None:
        s, win = _occurrences(self.w, x)
        np.add.at(self.edges, s, 1)
        np.add.at(self.edges, s + x["size"][win], -1)
        for r, v in set(zip(self.w.row[s].tolist(), win.tolist(), strict=True)):
            for m in x["members"][x["first"][v] : x["first"][v + 1]].tolist():
                self.items[r].add(x["name"][x["name_at"][m] : x["name_at"][m + 1]].tobytes().decode("utf-8", "surrogateescape"))

    @property
    def inside(self) -> np.ndarray:
        return np.cumsum(self.edges[:-1]) > 0


def _all_hits(batches: Iterator[pa.RecordBatch], blocks: list[tuple[str, int]]) -> Iterator[_Hits]:
    """Pieces of batches, held against all blocks."""
    chunk = CHUNK if sum(n for _, n in blocks) > CACHE // 2 else 0
    held, size = [], 0

    def flush() -> Iterator[_Hits]:
        for uri, _ in blocks:
            x = _load(uri)
            for h in held:
                h.look(x)
        yield from held

    for b in pieces(batches, "text"):
        held.append(_Hits(b))
        size += len(held[-1].w.data) + 40 * len(held[-1].w.hash)
        if size >= chunk:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_words: int = 2_000_000) -> DataFrame:
    """One row per document row: counts, items and hit word spans (word numbers, end exclusive).

    contaminated: some word is hit, and hit words are at least 1/``share`` of all.
    """
    blocks = build_index(benchmark, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in _all_hits(batches, blocks):
            b, w, inside, items = h.batch, h.w, h.inside, h.items
            n_hit, n_words = np.bincount(w.row[inside], minlength=b.num_rows), np.diff(w.first)
            names = [sorted(x) for x in items]
            # A window lies within its row, so spans of neighbouring rows must not be joined.
            opens, closes = inside.copy(), inside.copy()
            if len(inside):
                new = w.row[1:] != w.row[:-1]
                opens[1:] &= ~inside[:-1] | new
                closes[:-1] &= ~inside[1:] | new
            o, c = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for p, q in zip(o.tolist(), c.tolist(), strict=True):
                r = w.row[p]
                spans[r].append({"start": p - int(w.first[r]), "end": q - int(w.first[r])})
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array((n_hit > 0) & (share * n_hit >= n_words)),
                    pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_words: int = 2_000_000) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    blocks = build_index(benchmark, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in _all_hits(batches, blocks):
            n_hit = np.bincount(h.w.row[h.inside], minlength=h.batch.num_rows)
            yield h.batch.filter(pa.array((n_hit == 0) | (share * n_hit < np.diff(h.w.first))))

    return docs.mapInArrow(run, docs.schema)
