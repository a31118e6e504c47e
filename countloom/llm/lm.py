"""LM scoring with an Elias-Fano n-gram trie.

Level 1 holds the count of every training word (a 64-bit hash stands for a word),
and a word's place in it is its number; levels 2 and 3 hold n-grams of all words.
N-grams seen fewer than ``least`` times are pruned, their mass goes to the
back-off. Trigrams are counted where both their bigrams were kept, which all have
that are seen ``least`` times. Numbers of words with at least ``share`` of all
tokens, at most 1/share of them, are kept at hand to save searches for them.

The model is interpolated absolute discounting, P(w|h) = (c(hw) - d)/c(h) +
g(h) P(w|h'), where g(h) is what the kept n-grams leave, down to the add-one
unigram; so probabilities of all words sum to 1 in every context, up to the
quantisation of the stored ones (16 bits, steps of 1/2048 in log10).

A level is a sorted sequence of (parent node, word) keys, parent * words + word:
every parent's successors, relative to their parent's base, in one monotone
Elias-Fano sequence. A query searches the successor of its context's base plus
its word. Monotone pointers from parents to their first successors, also in
Elias-Fano form, enumerate a context. Levels are shards of plain arrays in the
shared folder, memory-mapped by the scorers; a few lines a shard come to the driver.

Counting is a sort: a task sorts and combines its keys, cuts them at the shards'
bounds and sends each shard one block (differences in byte planes); a shard's task
merges its blocks. Bounds come from the level above: a context is met as often as it
was counted, and followed by words as often as these occur, so every shard takes
at most about ``shard`` n-grams, and the successors of a hot context are cut into
as many shards as they need; what such a context leaves to its back-off is then
summed over them.

Defined cases: a null text is empty: one end token; a null doc_id counts as the
empty string in the fold; without training documents N and V are 0 and every
token has probability 1; repeated rows are counted and scored each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .elias_fano import EliasFano
from .store import attempt_name, fresh_path, open_fs, read_bytes, write_bytes
from .words import NON_SPACE, pieces, planes, unplanes, words

SHARE = 1e-5
LEAST = 2
DISCOUNT = 0.75
STEP = 2048.0
#: N-grams, repeats counted, that a shard takes at most, about; and bytes of text for a shard of words.
SHARD, SHARD_TEXT = 8_000_000, 64 << 20
#: Stands for the end of a document, and for what is before its first word.
END = np.uint64(0x9D39247E33776D41)


def held_out_rows(ids: pa.Array, of: int = 7, remainder: int = 2) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % of == remainder for i in ids.to_pylist()], bool)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): 63-bit keys of each row's words and its end; row r has first[r]:first[r + 1]."""
    w = words(column, NON_SPACE)
    n = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    keys = np.empty(first[-1], np.uint64)
    keys[first[1:] - 1] = END
    inner = np.ones(len(keys), bool)
    inner[first[1:] - 1] = False
    keys[inner] = w.hash
    return (keys >> np.uint64(1)).astype(np.int64), first


def encode_log(x: np.ndarray) -> np.ndarray:
    """log10 of a probability, down to 1e-32, in two bytes; 0 stands for 1."""
    return np.clip(np.round(-np.asarray(x) * STEP), 0, 65535).astype(np.uint16)


def unique_back(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values ascending, place of each value among them)."""
    codes, some = pd.factorize(x)
    order = np.argsort(some)
    rank = np.empty(len(some), np.int64)
    rank[order] = np.arange(len(some))
    return some[order], rank[codes]


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[new], np.add.reduceat(c, new) if len(new) else c


class Combiner:
    """Counts of keys within a task, combined before they leave it."""

    def __init__(self, most: int = 4_000_000):
        self.most, self.keys, self.counts, self.held = most, [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k, c = merge(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        return k, c


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in pieces(batches, "text", 4 << 20):
        learn = ~held_out_rows(b.column("doc_id"))
        if learn.any():
            yield tokens(b.column("text").filter(pa.array(learn)))


_BLOCKS = "shard int, n bigint, keys binary, counts binary"
_LINES = "shard int, name string, first bigint, nodes bigint, total bigint, ends array<bigint>, sums array<double>, knots array<bigint>, upto array<bigint>"


def _counted(docs: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], bounds: np.ndarray, write: Callable[[int, np.ndarray, np.ndarray], dict | None]) -> list[dict]:
    """Counts keys over all training documents by shards cut at ``bounds``; write(shard, keys, counts) gives a line."""

    def blocks(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cut = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
        some = np.flatnonzero(cut[1:] > cut[:-1])
        parts = [(keys[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]]) for i in some]
        packed = [planes(np.diff(k, prepend=np.int64(0))) for k, _ in parts], [planes(c) for _, c in parts]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([len(k) for k, _ in parts], pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["shard", "n", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Combiner()
        for keys, first in _training(batches):
            if c.add(keys_of(keys, first)):
                yield blocks(*c.take())
        yield blocks(*c.take())

    def gather(group: pa.Table) -> pa.Table:
        n = group.column("n").to_pylist()
        keys = [np.cumsum(unplanes(x.as_buffer(), m)) for x, m in zip(group.column("keys"), n, strict=True)]
        counts = [unplanes(x.as_buffer(), m) for x, m in zip(group.column("counts"), n, strict=True)]
        shard = group.column("shard")[0].as_py()
        line = write(shard, *merge(keys, counts))
        return pa.Table.from_pylist([{"shard": shard, **line}] if line else [], pa.schema([("shard", pa.int32()), ("name", pa.string()), *((c, pa.int64()) for c in ("first", "nodes", "total")), ("ends", pa.list_(pa.int64())), ("sums", pa.list_(pa.float64())), ("knots", pa.list_(pa.int64())), ("upto", pa.list_(pa.int64()))]))

    rows = docs.select("doc_id", "text").mapInArrow(run, _BLOCKS).groupBy("shard").applyInArrow(gather, _LINES).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["shard"])]


@dataclass
class Shards:
    """A level's shards in key order: first key, nodes before, nodes, folder."""

    base: str
    first: np.ndarray
    before: np.ndarray
    size: np.ndarray
    name: list[str]

    @classmethod
    def of(cls, base: str, lines: list[dict]) -> Shards:
        size = np.array([r["nodes"] for r in lines], np.int64)
        return cls(base, np.array([r["first"] for r in lines], np.int64), np.concatenate([[0], np.cumsum(size)])[: len(size)].astype(np.int64), size, [r["name"] for r in lines])


class _Cache:
    """Shards at hand in a worker: mapped ones by number, read ones by their bytes; the longest unused go first."""

    def __init__(self, most: int = 2048, most_bytes: int = 256 << 20):
        self.most, self.most_bytes, self.bytes, self.held = most, most_bytes, 0, OrderedDict()

    def get(self, at: str) -> dict:
        self.held.setdefault(at, {"_bytes": 0})
        self.held.move_to_end(at)
        return self.held[at]

    def grow(self, own: dict, size: int) -> None:
        own["_bytes"] += size
        self.bytes += size
        while len(self.held) > 1 and (len(self.held) > self.most or self.bytes > self.most_bytes):
            self.bytes -= self.held.popitem(last=False)[1]["_bytes"]


_mapped = _Cache()


def _save(base: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    for k, x in arrays.items():
        out = io.BytesIO()
        np.save(out, x)
        write_bytes(f"{base}/{name}/{k}.npy", out.getvalue())


def _map(base: str, name: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """A shard's arrays, memory-mapped where the shared folder is mounted, else read."""
    from pyarrow import fs

    at = f"{base}/{name}"
    own = _mapped.get(at)
    if missing := [n for n in names if n not in own]:
        where, path = open_fs(at)
        if isinstance(where, fs.LocalFileSystem):
            got = {n: np.load(f"{path}/{n}.npy", mmap_mode="r").view(np.ndarray) for n in missing}
            size = 0
        else:
            got = {n: np.load(io.BytesIO(read_bytes(f"{at}/{n}.npy"))) for n in missing}
            size = sum(x.nbytes for x in got.values())
        own |= got
        own.setdefault("_keys", EliasFano.of(own))
        _mapped.grow(own, size)
    return own


_EF = ("shape", "low", "high", "ones")
_LEVEL1 = (*_EF, "count")
_LEVEL = (*_EF, "prob", "ptr_shape", "ptr_low", "ptr_high", "ptr_ones", "left", "parents")
_LEVEL2 = (*_LEVEL, "seen")


def _find(level: Shards, keys: np.ndarray, names: tuple[str, ...], value: str) -> tuple[np.ndarray, np.ndarray]:
    """(node, value) of ascending keys; node -1 where a key is not there."""
    node, out = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    if not len(level.first) or not len(keys):
        return node, out
    cut = np.searchsorted(keys, level.first)
    cut = np.append(cut, len(keys))
    for s in range(len(level.first)):
        a, b = cut[s], cut[s + 1]
        if a < b:
            x = _map(level.base, level.name[s], names)
            i = x["_keys"].find(keys[a:b])
            ok = i >= 0
            node[a:b] = np.where(ok, i + level.before[s], -1)
            out[a:b][ok] = x[value][i[ok]]
    return node, out


def _at(level: Shards, nodes: np.ndarray, names: tuple[str, ...], value: str = "") -> np.ndarray:
    """A value of nodes in any order, or their keys."""
    some, back = unique_back(nodes)
    out = np.zeros(len(some), np.int64)
    cut = np.append(np.searchsorted(some, level.before), len(some))
    for s in range(len(level.before)):
        a, b = cut[s], cut[s + 1]
        if a < b:
            x = _map(level.base, level.name[s], names)
            i = some[a:b] - level.before[s]
            out[a:b] = x[value][i] if value else x["_keys"].access(i)
    return out[back]


def _left(level: Shards, parents: np.ndarray) -> np.ndarray:
    """Quantised log10 of what ascending parents leave to their back-off (0: all)."""
    out = np.zeros(len(parents), np.int64)
    if not len(level.first):
        return out
    # Where a parent's successors are cut, all its shards say the same.
    for s in range(len(level.first)):
        x = _map(level.base, level.name[s], _LEVEL)
        lo, n = int(x["parents"][0]), int(x["parents"][1])
        a, b = np.searchsorted(parents, lo), np.searchsorted(parents, lo + n)
        if a < b:
            out[a:b] = x["left"][parents[a:b] - lo]
    return out


@dataclass
class Model:
    tokens: int = 0
    vocabulary: int = 0
    word: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # keys of frequent words, ascending
    node: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # their numbers
    count: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    level1: Shards | None = None
    level2: Shards | None = None
    level3: Shards | None = None

    def p1(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + self.vocabulary + 1.0))

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of words; -1 and 0 of words that are not in level 1."""
        if self.level1 is None:
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        some, back = unique_back(keys)
        node, count = np.full(len(some), -1, np.int64), np.zeros(len(some), np.int64)
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, some), len(self.word) - 1)
            own = self.word[at] == some
            node[own], count[own] = self.node[at[own]], self.count[at[own]]
        rest = np.flatnonzero(node < 0)
        node[rest], count[rest] = _find(self.level1, some[rest], _LEVEL1, "count")
        return node[back], count[back]

    @property
    def end(self) -> int:
        return int(self.ids(np.array([int(END >> np.uint64(1))]))[0][0])


def _knots(nodes: int, mass: np.ndarray, points: int = 32) -> tuple[list[int], list[int]]:
    """(nodes, mass before them): some places at which a shard's mass is cut alike, and both sides of heavy nodes."""
    upto = np.concatenate([[0], np.cumsum(mass)])
    at = np.searchsorted(upto, np.linspace(0, upto[-1], points + 1), "right") - 1
    at = np.unique(np.clip(np.concatenate([at, at + 1, [0, nodes]]), 0, nodes))
    return at.tolist(), upto[at].tolist()


def _curve(level: Shards, lines: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """A level's knots as one ascending curve from nodes to mass."""
    x, y, total = [], [], 0
    for r, before in zip(lines, level.before.tolist(), strict=True):
        x.append(np.array(r["knots"], np.float64) + before)
        y.append(np.array(r["upto"], np.float64) + total)
        total += r["upto"][-1]
    return np.concatenate(x), np.concatenate(y)


def _bounds(parents: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], words_: int, shard: int, spread: int) -> np.ndarray:
    """Keys at which a level is cut: alike by how often parents occur and, within a parent, by how often words do."""
    (x, y), (wx, wy) = parents, words
    total = y[-1]
    n = int(max(-(-total // shard), min(spread, total // 50_000)))
    if n < 2:
        return np.empty(0, np.int64)
    at = np.interp(np.arange(1, n) * (total / n), y, x)
    parent = np.floor(at)
    word = np.floor(np.interp((at - parent) * wy[-1], wy, wx))
    return np.unique(np.minimum(parent.astype(np.int64), int(x[-1]) - 1) * words_ + np.minimum(word.astype(np.int64), words_ - 1))


def _gram_writer(base: str, words_: int, least: int, discount: float):
    """Keeps a shard's keys that are seen often enough, and says what its first and last contexts keep."""

    def write(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict | None:
        ok = counts >= least
        if not ok.any():
            return None
        keys, counts = keys[ok], counts[ok]
        name = attempt_name(shard)
        _save(base, name, {"raw": keys, "seen": counts.astype(np.uint32) if counts.max() < 1 << 32 else counts})
        parent = keys // words_
        ends = [int(parent[0]), int(parent[-1])][: 1 + (parent[-1] > parent[0])]
        knots, upto = _knots(len(keys), counts)
        return {"name": name, "first": int(keys[0]), "nodes": len(keys), "total": int(counts.sum()), "ends": ends, "sums": [float((counts[parent == e] - discount).sum()) for e in ends], "knots": knots, "upto": upto}

    return write


def _finish(spark, level: Shards, lines: list[dict], words_: int, discount: float, totals, lower) -> None:
    """Writes the shards' tries. totals(parents ascending): their counts; lower(parents, words): log10 of the back-off."""
    sums: dict[int, float] = {}
    for r in lines:
        for e, x in zip(r["ends"], r["sums"], strict=True):
            sums[e] = sums.get(e, 0.0) + x
    ends = np.array(sorted(sums), np.int64)
    whole = np.array([sums[e] for e in ends.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("id").to_pylist():
                at = f"{level.base}/{level.name[s]}"
                key, n = (np.load(io.BytesIO(read_bytes(f"{at}/{k}.npy"))) for k in ("raw", "seen"))
                parent, w = key // words_, key % words_
                some, back = unique_back(parent)
                taken = n - discount
                kept = np.bincount(back, taken)
                i = np.minimum(np.searchsorted(ends, some), len(ends) - 1)
                kept = np.where(ends[i] == some, whole[i], kept)
                total = totals(some).astype(np.float64)
                left = np.maximum(1 - kept / total, 1e-30)
                prob = taken / total[back] + left[back] * 10 ** lower(parent, w)
                lo, size = int(some[0]), int(some[-1] - some[0]) + 1
                quantised = np.zeros(size, np.uint16)
                quantised[some - lo] = encode_log(np.log10(left))
                ptr = EliasFano.build(np.searchsorted(parent - lo, np.arange(size + 1)))
                arrays = EliasFano.build(key).arrays() | {"prob": encode_log(np.log10(prob))} | {f"ptr_{k}": v for k, v in ptr.arrays().items()}
                _save(level.base, level.name[s], arrays | {"left": quantised, "parents": np.array([lo, size])})
            yield pa.RecordBatch.from_arrays([b.column("id")], ["id"])

    # One shard a partition; a task that runs again writes the same bytes.
    spark.range(0, len(lines), 1, len(lines)).mapInArrow(run, "id bigint").count()


def train(docs: DataFrame, share: float = SHARE, least: int = LEAST, discount: float = DISCOUNT, shard: int = SHARD) -> Model:
    """The model of all documents that are not held out."""
    spark = docs.sparkSession
    base = fresh_path(spark, "lm")
    at1, at2, at3 = f"{base}/1", f"{base}/2", f"{base}/3"
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(min(spread, 64), -(-size // SHARD_TEXT) if size < 1 << 60 else 0)

    def level1(number: int, keys: np.ndarray, n: np.ndarray) -> dict | None:
        if not len(keys):
            return None
        name = attempt_name(number)
        _save(at1, name, EliasFano.build(keys).arrays() | {"count": n.astype(np.uint32) if n.max() < 1 << 32 else n})
        knots, upto = _knots(len(keys), n, 256)
        return {"name": name, "first": int(keys[0]), "nodes": len(keys), "total": int(n.sum()), "ends": [], "sums": [], "knots": knots, "upto": upto}

    # Words' keys are hashes, so equal ranges of them are alike.
    lines1 = _counted(docs, lambda keys, _: keys, np.arange(1, parts, dtype=np.int64) * ((1 << 63) // parts), level1)
    model = Model(tokens=sum(r["total"] for r in lines1), vocabulary=sum(r["nodes"] for r in lines1), level1=Shards.of(at1, lines1))
    if not model.tokens:
        return model
    floor, one = max(2, int(np.ceil(share * model.tokens))), model.level1

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column("id").to_pylist():
                x = _map(at1, one.name[s], _LEVEL1)
                at = np.flatnonzero(x["count"] >= floor)
                yield pa.RecordBatch.from_arrays([pa.array(x["_keys"].access(at), pa.int64()), pa.array(at + one.before[s]), pa.array(x["count"][at].astype(np.int64))], ["key", "node", "n"])

    top = sorted(spark.range(0, len(lines1), 1, min(len(lines1), 64)).mapInArrow(frequent, "key bigint, node bigint, n bigint").collect())  # at most 1/share rows
    model.word, model.node, model.count = (np.array([r[c] for r in top], np.int64) for c in ("key", "node", "n"))
    words_ = model.vocabulary
    if words_ >= 3 << 30:
        raise ValueError("too many words for 63-bit keys of bigrams")
    curve = _curve(one, lines1)
    small = Model(model.tokens, model.vocabulary, model.word, model.node, model.count, one)
    end = small.end

    def bigrams(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        w, count = small.ids(keys)
        # What is seen too seldom itself is in no n-gram that is seen often enough.
        ok = (count >= least) & (before_each(count, first, least) >= least)
        return (before_each(w, first, end) * words_ + w)[ok]

    lines2 = _counted(docs, bigrams, _bounds(curve, curve, words_, shard, spread), _gram_writer(at2, words_, least, discount))
    if not lines2:
        return model
    model.level2 = Shards.of(at2, lines2)
    if int(model.level2.size.sum()) * words_ >= 1 << 63:
        raise ValueError("too many bigrams for 63-bit keys of trigrams")
    _finish(
        spark, model.level2, lines2, words_, discount, lambda v: _at(small.level1, v, _LEVEL1, "count"),
        lambda v, w: small.p1(_at(small.level1, w, _LEVEL1, "count")),
    )
    two = Model(model.tokens, model.vocabulary, model.word, model.node, model.count, one, model.level2)

    def trigrams(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        w, count = two.ids(keys)
        v = before_each(w, first, end)
        some = np.flatnonzero((count >= least) & (before_each(count, first, least) >= least))
        key, back = unique_back(v[some] * words_ + w[some])
        node = np.full(len(w), -1, np.int64)
        node[some] = _find(two.level2, key, _LEVEL2, "seen")[0][back]
        parent = before_each(node, first)
        ok = (parent >= 0) & (node >= 0)
        return parent[ok] * words_ + w[ok]

    lines3 = _counted(docs, trigrams, _bounds(_curve(model.level2, lines2), curve, words_, shard, spread), _gram_writer(at3, words_, least, discount))
    if not lines3:
        return model
    model.level3 = Shards.of(at3, lines3)

    def lower(parent: np.ndarray, w: np.ndarray) -> np.ndarray:
        some, at = unique_back(parent)
        v = (_at(two.level2, some, _LEVEL2) % words_)[at]
        return _bigram(two, v, w, two.p1(_at(two.level1, w, _LEVEL1, "count")))[0]

    _finish(spark, model.level3, lines3, words_, discount, lambda v: _at(two.level2, v, _LEVEL2, "seen"), lower)
    return model


def before_each(x: np.ndarray, first: np.ndarray, start: int = -1) -> np.ndarray:
    """What stands before each token of its document."""
    out = np.concatenate([[start], x[:-1]])
    out[first[:-1]] = start
    return out


def contexts(w: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Numbers of the words before each token; the end stands before the first, and nothing before that."""
    return before_each(w, first, end)


def _bigram(model: Model, v: np.ndarray, w: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(w|v), node of (v, w) or -1)."""
    words_ = model.vocabulary
    p, node = p1.copy(), np.full(len(w), -1, np.int64)
    if model.level2 is None:
        return p, node
    has = np.flatnonzero(v >= 0)
    some, at = unique_back(v[has])
    p[has] -= (_left(model.level2, some) / STEP)[at]
    both = has[w[has] >= 0]
    key, at = unique_back(v[both] * words_ + w[both])
    n, q = _find(model.level2, key, _LEVEL2, "prob")
    found = n[at] >= 0
    node[both] = n[at]
    p[both[found]] = -(q / STEP)[at][found]
    return p, node


def score_tokens(model: Model, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(training count, base log10, model log10) of each token."""
    w, count = model.ids(keys)
    p1 = model.p1(count)
    p, node = _bigram(model, contexts(w, first, model.end), w, p1)
    if model.level3 is not None:
        words_ = model.vocabulary
        parent = before_each(node, first)
        has = np.flatnonzero(parent >= 0)
        some, at = unique_back(parent[has])
        p[has] -= (_left(model.level3, some) / STEP)[at]
        both = has[w[has] >= 0]
        key, at = unique_back(parent[both] * words_ + w[both])
        n, q = _find(model.level3, key, _LEVEL, "prob")
        found = n[at] >= 0
        p[both[found]] = -(q / STEP)[at][found]
    return count, p1, p


SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 4 << 20):
            keys, first = tokens(b.column("text"))
            count, base, p = score_tokens(model, keys, first)
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            total = lambda x: np.bincount(row, x, b.num_rows)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()), pa.array(held_out_rows(b.column("doc_id"))), pa.array(np.diff(first)), pa.array(total(count > 0).astype(np.int64)),
                    pa.array(np.full(b.num_rows, model.tokens, np.int64)), pa.array(total(base)), pa.array(total(p)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
