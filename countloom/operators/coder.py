"""Entropy coding of whole matrices: a task codes a run of genes of a sample.

Range-variant asymmetric numeral systems with 12-bit frequencies. Contexts look at
earlier rows only, so rows are taken in waves: all of a wave have their neighbours in
earlier ones, have known probabilities at once and are coded side by side. ``Lanes`` holds
many states in one array, which write 16-bit words into one stream in a fixed order (Giesen, 2014).

Work and memory follow positives and genes, never rows times genes. A cell with a positive
neighbour is a symbol of its own; all others of a gene have one probability, so what is
coded is how many of them are passed before the next positive: a geometric number, digit
by digit, with as many bits as its cells would cost one by one.

What a cell's neighbours hold of its gene has nothing to do with other genes, so a sample is
cut into runs of genes, each with its own streams and the sample's graph. A run has
``SPAN`` positives and genes, or twice as many as there are rows, so that all copies of the graph
together grow as the positives do.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BUCKET_EDGES, CONTEXT_ENDS, Q12, STARTUP, U32
from ..sources.archive import PART, csr, sliced
from ..sources.matrix import CountMatrix, few
from ..sources.shared import materialise
from . import sharing, support
from .study import Study

LANE_LOWER = 1 << 16
WIDTH = 6
_BITS = 12 - np.log2(np.maximum(np.arange(Q12 + 1), 1))


class LaneWriter:
    """As many states as lanes; runs of symbols go in from the last to the first."""

    def __init__(self, lanes: int):
        self.state, self.words = np.full(lanes, LANE_LOWER, np.int64), []

    def put(self, start: np.ndarray, freq: np.ndarray) -> None:
        """A run of any length: symbol i goes to lane i modulo lanes."""
        lanes = len(self.state)
        for a in range((len(freq) - 1) // lanes * lanes, -1, -lanes):
            f, s = freq[a : a + lanes], start[a : a + lanes]
            x = self.state[: len(f)]
            over = x >= f << 20
            if over.any():
                self.words.append((x[over] & 0xFFFF).astype("<u2"))
                x = np.where(over, x >> 16, x)
            q, r = np.divmod(x, f)
            self.state[: len(f)] = (q << 12) + r + s

    def bytes(self) -> bytes:
        return struct.pack("<I", len(self.state)) + self.state.astype("<u4").tobytes() + b"".join(w.tobytes() for w in reversed(self.words))


class LaneReader:
    def __init__(self, blob: bytes):
        lanes = struct.unpack_from("<I", blob)[0] if len(blob) >= 4 else 0
        if not lanes or len(blob) < 4 + 4 * lanes or len(blob) % 2:
            raise ValueError("truncated stream")
        self.state = np.frombuffer(blob, "<u4", lanes, 4).astype(np.int64)
        self.words, self.at = np.frombuffer(blob, "<u2", offset=4 + 4 * lanes).astype(np.int64), 0
        if (self.state < LANE_LOWER).any():
            raise ValueError("invalid first state")

    def _take(self, start: np.ndarray, freq: np.ndarray) -> None:
        now = self.state[: len(freq)]
        x = freq * (now >> 12) + (now & (Q12 - 1)) - start
        under = np.flatnonzero(x < LANE_LOWER)
        if len(under):
            if self.at + len(under) > len(self.words):
                raise ValueError("truncated stream")
            x[under] = (x[under] << 16) | self.words[self.at : self.at + len(under)]
            self.at += len(under)
        self.state[: len(freq)] = x

    def runs(self, n: int, choose) -> np.ndarray:
        """n symbols; choose(from, to, slots) gives their (symbols, starts, frequencies)."""
        lanes, out = len(self.state), np.empty(n, np.int64)
        for a in range(0, n, lanes):
            b = min(n, a + lanes)
            out[a:b], start, freq = choose(a, b, self.state[: b - a] & (Q12 - 1))
            self._take(start, freq)
        return out

    def flags(self, q: np.ndarray) -> np.ndarray:
        """One bit for each Q12 probability of a one."""

        def choose(a: int, b: int, slot: np.ndarray):
            p = q[a:b]
            one = slot >= Q12 - p
            return one, np.where(one, Q12 - p, 0), np.where(one, p, Q12 - p)

        return self.runs(len(q), choose).astype(bool)

    def close(self) -> None:
        if self.at != len(self.words) or (self.state != LANE_LOWER).any():
            raise ValueError("stream does not end where it should")


def _odds_q(q: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The largest product is below 2**52."""
    q = np.asarray(q, np.int64)
    num = q * odds
    den = num + (Q12 - q) * 65536
    return np.clip((Q12 * num + den // 2) // den, 1, Q12 - 1)


def _raw_widths(k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k raw bits of values in pieces of at most 12, the highest first: (places, widths, bits below the piece)."""
    for done in (0, 12, 24):
        at = np.flatnonzero(k > done)
        if len(at):
            width = np.minimum(12, k[at] - done)
            yield at, width, k[at] - done - width


#: Neighbours' positives that are looked at together. Fixed value: the order of symbols depends on it.
PAIRS = 1_000_000
_ONE = 1 << 31


def digit_odds(digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Q12 probabilities (inner, last) of a one, by Q12 rate of positives and digit, in integers alone.

    With p the chance of a zero cell, p ** 2 ** j is that of passing 2 ** j of them. A digit j is
    p ** 2 ** j times as likely to be one as to be zero; where the upper half has no end, that is its whole chance.
    """
    x = (Q12 - np.arange(Q12, dtype=np.int64)) << 19
    inner, last = np.empty((Q12, max(1, digits)), np.int64), np.empty((Q12, max(1, digits)), np.int64)
    for j in range(digits):
        inner[:, j], last[:, j] = (x * Q12 + (_ONE + x) // 2) // (_ONE + x), (x * Q12 + _ONE // 2) >> 31
        x = (x * x + _ONE // 2) >> 31
    return np.clip(inner, 1, Q12 - 1), np.clip(last, 1, Q12 - 1)


class Found:
    """Positives by row: ``size`` genes from ``start`` on; rows are added in any order."""

    def __init__(self, n: int, genes: int):
        self.start, self.size, self.g, self.n, self.genes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.empty(1024, np.int64), 0, genes

    def add(self, rows: np.ndarray, keys: np.ndarray) -> None:
        """keys: place in ``rows`` times genes plus gene, sorted."""
        while self.n + len(keys) > len(self.g):
            self.g = np.concatenate([self.g, np.empty_like(self.g)])
        self.g[self.n : self.n + len(keys)] = keys % self.genes
        self.size[rows] = np.bincount(keys // self.genes, minlength=len(rows))
        self.start[rows] = self.n + np.cumsum(self.size[rows]) - self.size[rows]
        self.n += len(keys)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, place in ``g``) of the rows' positives."""
        size = self.size[rows]
        return np.repeat(np.arange(len(rows)), size), np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows`` times genes plus gene, place in ``g``)."""
        row, at = self.of(rows)
        return row * self.genes + self.g[at], at


def _places(needles: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in sorted ``keys``, whether it is there) of each needle."""
    if not len(keys):
        return np.zeros(len(needles), np.int64), np.zeros(len(needles), bool)
    at = np.minimum(np.searchsorted(keys, needles), len(keys) - 1)
    return at, keys[at] == needles


class Model:
    """Probabilities of the symbols of a run of genes, from its sample's model tables."""

    def __init__(self, graph: np.ndarray, q0: np.ndarray, support_odds: np.ndarray, rate: np.ndarray, group: np.ndarray, value_odds: np.ndarray, tail: np.ndarray, bucket: np.ndarray):
        self.n, self.genes, self.graph, self.q0 = len(graph), len(q0), graph, q0.astype(np.int64)
        self.group, self.tail = group.astype(np.int64), tail.astype(np.int64)
        self.below = np.concatenate([np.zeros((*tail.shape[:2], 1), np.int64), np.cumsum(self.tail, 2)], 2)
        self.support_q = _odds_q(np.repeat(self.q0[:, None], 7, 1), support_odds[bucket])
        self.value_q = np.concatenate([_odds_q(np.repeat(rate[:, None], 7, 1), value_odds[self.group]), rate[:, None]], 1)
        # Rows of the start come first, one by one; a later row comes a wave after the last of its neighbours.
        self.first = min(self.n, WIDTH)
        wave = [0] * self.first
        for near in graph[self.first :].tolist():
            wave.append(1 + max([wave[j] for j in near]))
        late = np.array(wave[self.first :], np.int64)
        self.late = self.first + np.argsort(late, kind="stable")
        self._waves = [0, *(np.flatnonzero(np.diff(np.sort(late))) + 1), len(late)]
        self.inner, self.last = digit_odds(int(len(late)).bit_length())

    def pieces(self, found: Found) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first, rows) in order: waves, cut where their neighbours hold much."""
        for a, b in zip(self._waves[:-1], self._waves[1:], strict=True):
            load = np.cumsum(found.size[self.graph[self.late[a:b]]].sum(1)) // PAIRS
            cuts = [0, *(np.flatnonzero(np.diff(load)) + 1), b - a]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x:
                    yield a + x, self.late[a + x : a + y]

    def near(self, rows: np.ndarray, found: Found) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows`` times genes plus gene, place in ``found.g``) of what the rows' neighbours hold."""
        keys, at = found.keys(self.graph[rows].ravel())
        return keys // (WIDTH * self.genes) * self.genes + keys % self.genes, at

    def _digits(self, gene: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, object]]:
        """(digit, choose) from the highest on; choose(base) gives (places, Q12 of a one) of those that the digit is open for."""
        q = self.support_q[gene, 0]
        for j in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):

            def choose(base: np.ndarray, j: int = j):
                at = np.flatnonzero(base + (1 << j) <= most)
                return at, np.where(base[at] + (2 << j) > most[at], self.last[q[at], j], self.inner[q[at], j])

            yield j, choose

    def encode_support(self, found: Found, lanes: int) -> tuple[bytes, float, float]:
        """(stream, bits by cells, bits of the symbols that stand for them)."""
        total, nnz = len(self.late), found.n
        runs: list[tuple] = []
        for i in range(self.first):
            truth = np.zeros(self.genes, bool)
            truth[found.g[found.start[i] : found.start[i] + found.size[i]]] = True
            runs.append((self.q0, truth))
        # A gap is open from a positive on; how long it is shows at the next.
        gap, most, of = np.full(self.genes + nnz, -1, np.int64), np.full(self.genes + nnz, total, np.int64), np.zeros(self.genes + nnz, np.int64)
        of[: self.genes], used, opened, passed, alone = np.arange(self.genes), self.genes, np.arange(self.genes), np.zeros(self.genes, np.int64), np.zeros(self.genes, np.int64)
        runs.append((0, used))
        for at, rows in self.pieces(found):
            m = len(rows)
            keys, k = np.unique(self.near(rows, found)[0], return_counts=True)
            own = found.keys(rows)[0]
            row, gene = keys // self.genes, keys % self.genes
            runs.append((self.support_q[gene, k], _places(keys, own)[1]))
            quiet = own[~_places(own, keys)[1]]
            looked = np.bincount(gene, minlength=self.genes)
            alone += looked
            by_gene = np.sort(gene * m + row)
            key = np.sort(quiet % self.genes * m + quiet // self.genes)
            g, place = key // m, key % m
            c = place - (np.searchsorted(by_gene, key) - np.searchsorted(by_gene, g * m))
            first = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
            head = np.flatnonzero(first)
            turn = np.arange(len(g)) - np.repeat(head, np.diff([*head, len(g)]))
            order = np.lexsort((g, turn))
            name = np.empty(len(g), np.int64)
            name[order] = used + np.arange(len(g))
            before = np.concatenate([[0], name[:-1]])[: len(g)]
            gap[np.where(first, opened[g], before)] = np.where(first, passed[g] + c, c - np.concatenate([[0], c[:-1]])[: len(g)] - 1)
            of[name], most[name] = g, total - (at + place) - 1
            cuts = used + np.concatenate([[0], np.cumsum(np.bincount(turn))]) if len(g) else []
            runs += list(zip(cuts[:-1], cuts[1:], strict=True))
            used += len(g)
            passed += m - looked
            end = np.concatenate([head[1:] - 1, [len(g) - 1]]) if len(g) else head
            passed[g[end]], opened[g[end]] = m - looked[g[end]] - c[end] - 1, name[end]
        gap = np.where(gap < 0, most, gap)
        q, single = self.support_q[:, 0], np.bincount(of[self.genes : used], minlength=self.genes)
        cells, coded = float(((total - alone - single) * _BITS[Q12 - q] + single * _BITS[q]).sum()), 0.0
        out = LaneWriter(lanes)
        flags = lambda p, one: (np.where(one, Q12 - p, 0), np.where(one, p, Q12 - p))
        for a, b in reversed(runs):
            if isinstance(a, np.ndarray):
                start, freq = flags(a, b)
                out.put(start, freq)
                cells += float(_BITS[freq].sum())
                coded += float(_BITS[freq].sum())
                continue
            value = gap[a:b]
            for j, choose in reversed(list(self._digits(of[a:b], most[a:b]))):
                at, p = choose(value >> (j + 1) << (j + 1))
                start, freq = flags(p, (value[at] >> j & 1).astype(bool))
                out.put(start, freq)
                coded += float(_BITS[freq].sum())
        return out.bytes(), cells, coded

    def decode_support(self, blob: bytes, nnz: int) -> Found:
        src, found, total = LaneReader(blob), Found(self.n, self.genes), len(self.late)

        def gaps(gene: np.ndarray, most: np.ndarray) -> np.ndarray:
            value = np.zeros(len(gene), np.int64)
            for j, choose in self._digits(gene, most):
                at, p = choose(value)
                value[at] += src.flags(p).astype(np.int64) << j
            return value

        for i in range(self.first):
            found.add(np.array([i]), np.flatnonzero(src.flags(self.q0)))
        left = gaps(np.arange(self.genes), np.full(self.genes, total))
        for at, rows in self.pieces(found):
            m = len(rows)
            keys, k = np.unique(self.near(rows, found)[0], return_counts=True)
            row, gene = keys // self.genes, keys % self.genes
            got = [keys[src.flags(self.support_q[gene, k])]]
            looked = np.bincount(gene, minlength=self.genes)
            first, quiet, past = np.cumsum(looked) - looked, m - looked, np.zeros(self.genes, np.int64)
            by_gene = np.sort(gene * m + row)
            # Cells to pass before a place that is looked at; the c-th of the others lies behind as many of those as need no more than c.
            ahead = by_gene // m * (m + 1) + by_gene % m - (np.arange(len(keys)) - first[by_gene // m])
            due = np.flatnonzero(left < quiet)
            while len(due):
                c = past[due] + left[due]
                place = c + np.searchsorted(ahead, due * (m + 1) + c, "right") - first[due]
                got.append(place * self.genes + due)
                past[due] = c + 1
                left[due] = gaps(due, total - (at + place) - 1)
                due = due[left[due] < quiet[due] - past[due]]
                if found.n + sum(map(len, got)) > nnz:
                    raise ValueError("number of positives")
            left -= quiet - past
            found.add(rows, np.sort(np.concatenate(got)))
            if found.n > nnz:
                raise ValueError("number of positives")
        src.close()
        return found

    def steps(self, found: Found) -> Iterator[tuple[np.ndarray, object]]:
        """(places of positives, contexts of them by the values before) of the start, one row after another, and of all pieces."""
        at = found.of(np.arange(self.first))[1]
        yield at, lambda v, n=len(at): np.full(n, STARTUP)
        for _, rows in self.pieces(found):
            own, at = found.keys(rows)

            def contexts(v: np.ndarray, own: np.ndarray = own, rows: np.ndarray = rows):
                keys, near = self.near(rows, found)
                to, there = _places(keys, own)
                total = np.bincount(to[there], v[near[there]], len(own))
                return np.where(total == 0, 0, 1 + np.searchsorted(CONTEXT_ENDS, total, "right"))

            yield at, contexts

    def encode_values(self, found: Found, values: np.ndarray, lanes: int) -> tuple[bytes, float]:
        out, cost, runs = LaneWriter(lanes), 0.0, []
        for at, contexts in self.steps(found):
            genes, v = found.g[at], values[at]
            if not len(genes):
                continue
            c = contexts(values)
            q, big = self.value_q[genes, c], np.flatnonzero(v > 1)
            k = np.frexp((v[big] - 1).astype(np.float64))[1].astype(np.int64) - 1
            rest = v[big] - 1 - (1 << k)
            one, b = v == 1, self.group[genes[big]]
            f, freq = self.tail[b, c[big], k], np.where(one, q, Q12 - q)
            runs += [(np.where(one, Q12 - q, 0), freq), (self.below[b, c[big], k], f)]
            runs += [(((rest[x] >> low) & ((1 << width) - 1)) << (12 - width), 1 << (12 - width)) for x, width, low in _raw_widths(k)]
            cost += float(_BITS[freq].sum() + _BITS[f].sum() + k.sum())
        for start, freq in reversed(runs):
            out.put(start, freq)
        return out.bytes(), cost

    def decode_values(self, blob: bytes, found: Found) -> np.ndarray:
        values, src = np.zeros(found.n, np.int64), LaneReader(blob)
        for here, contexts in self.steps(found):
            genes = found.g[here]
            if not len(genes):
                continue
            c = contexts(values)
            v = np.ones(len(genes), np.int64)
            big = np.flatnonzero(~src.flags(self.value_q[genes, c]))
            group, near = self.group[genes[big]], c[big]

            def magnitude(a: int, b: int, slot: np.ndarray, group=group, near=near):
                table, below = self.tail[group[a:b], near[a:b]], self.below[group[a:b], near[a:b]]
                k = (below[:, 1:] <= slot[:, None]).sum(1)
                own = np.arange(b - a)
                return k, below[own, k], table[own, k]

            k = src.runs(len(big), magnitude)
            rest = np.zeros(len(big), np.int64)
            for at, width, low in _raw_widths(k):

                def piece(a: int, b: int, slot: np.ndarray, width=width):
                    w = 12 - width[a:b]
                    return slot >> w, (slot >> w) << w, 1 << w

                rest[at] |= src.runs(len(at), piece) << low
            v[big] = (1 << k) + rest + 1
            if (v > U32).any():
                raise ValueError("value beyond 32 bits")
            values[here] = v
        src.close()
        return values


# The members of an archive.
MEMBERS = (
    "metadata.bz2", "graph.bz2", "base_probability.bz2", "shared_odds.u32", "support.rans", "value_q1.bz2", "value_group.bz2", "value_base_k.bz2", "value_odds.u32", "value_cond_k.bz2", "values.rans",
)
METADATA = "countloom-axes-1"


def buckets_of(q: np.ndarray, edges: tuple[int, ...]) -> np.ndarray:
    return np.maximum(0, np.searchsorted(edges, q, "right") - 1)


def _packed(a: np.ndarray, kind: str) -> bytes:
    return bz2.compress(np.ascontiguousarray(a, kind).tobytes(), 9)


def _unpacked(raw: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    """Refuses anything but the one stream of the one size."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    unzip = bz2.BZ2Decompressor()
    try:
        got = unzip.decompress(raw, max_length=size + 1)
    except (OSError, EOFError) as e:
        raise ValueError("compression") from e
    if len(got) != size or unzip.unused_data or not unzip.eof:
        raise ValueError("length")
    return np.frombuffer(got, kind).reshape(shape)


def digest_of(n: int, genes: int, ptr: np.ndarray, g: np.ndarray, v: np.ndarray) -> str:
    return hashlib.sha256(b"".join(np.asarray(p).astype("<u8").tobytes() for p in ([n, genes], ptr, g, v))).hexdigest()


def metadata_bytes(spot_ids: list, gene_ids: list, xy: np.ndarray) -> bytes:
    """The metadata document, the same bytes for the same contents."""
    meta = {
        "form": METADATA, "rows": spot_ids, "columns": gene_ids, "places": {"shape": list(xy.shape), "type": xy.dtype.str, "base64": base64.b64encode(np.ascontiguousarray(xy).tobytes()).decode()},
    }
    return (json.dumps(meta, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n").encode()


#: Kinds of what a run of genes needs besides its cells.
SIZE, GENE, EDGE, CENTRE, SUPPORT, VALUE, TAIL, SPOT = range(8)


class Run:
    """A run of genes of a sample, out of its cells (i, g, v) and rows (kind, a, b, c, d, e, x, y, t, edges)."""

    def __init__(self, cells: pa.Table, rest: pa.Table, groups: int = 8):
        kind = np.asarray(rest.column("kind"))
        table = lambda k: rest.filter(pa.array(kind == k))
        get = lambda k: (lambda t: np.stack([np.asarray(t.column(c).fill_null(0), np.int64) for c in "abcde"], 1))(table(k))
        (self.n, self.columns, *_), self.k = get(SIZE)[0].tolist(), groups
        genes = table(GENE).sort_by("a")
        g = np.asarray(genes.column("a"), np.int64)
        self.first, self.genes, self.gene_ids = int(g[0]), len(g), genes.column("t").to_pylist()
        self.q0, self.group, self.own, exception = (np.asarray(genes.column(c), np.int64) for c in "bcde")
        self.bucket, self.exception = buckets_of(self.q0, BUCKET_EDGES), exception.astype(bool) if (exception >= 0).any() else None
        i, g, v = (np.asarray(cells.column(c), np.int64) for c in "igv")
        order = np.lexsort((g, i))
        self.v, self.found = v[order], Found(self.n, self.genes)
        self.found.add(np.arange(self.n), i[order] * self.genes + g[order] - self.first)
        spots = table(SPOT).sort_by("a")
        self.spot_ids, self.xy = spots.column("t").to_pylist(), np.stack([np.asarray(spots.column(c), np.float64) for c in "xy"], 1)
        self.graph = np.full((self.n, WIDTH), -1, np.int64)
        edges = table(EDGE).column("edges").combine_chunks().flatten()
        i, r, j = (np.asarray(edges.field(c), np.int64) for c in "irj")
        self.graph[i, r - 1] = j
        self.centre = (lambda c: c[np.argsort(c[:, 0]), 1])(get(CENTRE))
        self.support_odds, self.value_odds = np.full((8, 7), 65536, np.int64), np.full((groups, 7), 65536, np.int64)
        for odds, k in ((self.support_odds, SUPPORT), (self.value_odds, VALUE)):
            x = get(k)
            odds[x[:, 0], x[:, 1]] = x[:, 2]
        t = get(TAIL)
        self.tail = np.zeros((groups, 8, 32), np.int64)
        self.tail[t[:, 0], t[:, 1] // 32, t[:, 1] % 32] = t[:, 2]

    @property
    def rate(self) -> np.ndarray:
        """Q12 rate of ones by gene: its group's centre or, for exceptions, its own."""
        shared = self.centre[self.group]
        return shared if self.exception is None else np.where(self.exception, self.own, shared)

    def model(self) -> Model:
        return Model(self.graph, self.q0, self.support_odds, self.rate, self.group, self.value_odds, self.tail, self.bucket)

    def lanes(self) -> tuple[int, int]:
        """Lanes of the two streams: many enough to fill arrays, few enough for their states not to count."""
        return int(np.clip((self.genes + self.found.n) // 256, 1, 2048)), int(np.clip(self.found.n // 256, 1, 1024))

    def digest(self) -> str:
        return digest_of(self.n, self.genes, np.concatenate([[0], np.cumsum(self.found.size)]), self.first + self.found.g[: self.found.n], self.v)

    def members(self) -> tuple[dict[str, bytes], dict]:
        """(members, what the manifest says) of the run's archive. Rows are labelled in a sample's first."""
        model, (wide, narrow) = self.model(), self.lanes()
        meta = metadata_bytes(self.spot_ids, self.gene_ids, self.xy)
        parts = {
            "metadata.bz2": bz2.compress(meta, 9), "graph.bz2": _packed(self.graph, "<i4"), "base_probability.bz2": _packed(self.q0, "<u2"), "shared_odds.u32": self.support_odds.astype("<u4").tobytes(),
            "support.rans": model.encode_support(self.found, wide)[0], "value_q1.bz2": sharing.encode(self.centre, self.group, self.own, self.exception), "value_group.bz2": _packed(self.group, "u1"),
            "value_base_k.bz2": _packed(self.tail[:, 7], "<u2"), "value_odds.u32": self.value_odds.astype("<u4").tobytes(), "value_cond_k.bz2": _packed(self.tail[:, :7], "<u2"),
            "values.rans": model.encode_values(self.found, self.v, narrow)[0],
        }
        info = {
            "shape": [self.n, self.genes], "first": self.first, "columns": self.columns, "nnz": self.found.n, "groups": self.k, "mode": 0 if self.exception is None else 1, "buckets": 8, "predecessors": WIDTH,
            "canonical_sha256": self.digest(), "metadata_sha256": hashlib.sha256(meta).hexdigest(),
        }
        return parts, info


def graph_ok(graph: np.ndarray) -> bool:
    """Row i has exactly min(i, width) distinct earlier rows, and nothing after them."""
    n, width = graph.shape
    own, place = np.arange(n)[:, None], np.arange(width)
    due = place < own
    some = np.where(due, graph, -1 - place)  # distinct fillers
    ordered = np.sort(some, 1)
    return bool((graph[due] >= 0).all() and (np.where(due, graph, -1) < own).all() and (graph[~due] == -1).all() and (np.diff(ordered, axis=1) > 0).all())


def decode_members(parts: dict[str, bytes], info: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(rows, genes, values, metadata) from an archive alone; refuses whatever does not fit."""
    (n, genes), k = (int(x) for x in info["shape"]), int(info["groups"])
    graph = _unpacked(parts["graph.bz2"], "<i4", (n, WIDTH)).astype(np.int64)
    if not graph_ok(graph):
        raise ValueError("graph")
    q0 = _unpacked(parts["base_probability.bz2"], "<u2", (genes,)).astype(np.int64)
    group = _unpacked(parts["value_group.bz2"], "u1", (genes,)).astype(np.int64)
    tail = np.concatenate([_unpacked(parts["value_cond_k.bz2"], "<u2", (k, 7, 32)), _unpacked(parts["value_base_k.bz2"], "<u2", (k, 1, 32))], 1)
    odds = {m: np.frombuffer(parts[m], "<u4").astype(np.int64) for m in ("shared_odds.u32", "value_odds.u32")}
    if (q0 < 1).any() or (q0 >= Q12).any() or (group >= k).any() or (tail < 1).any() or (tail.sum(2) != Q12).any() or len(odds["shared_odds.u32"]) != 56 or len(odds["value_odds.u32"]) != 7 * k:
        raise ValueError("model tables")
    if any((o < 22).any() or (o > 195360063).any() for o in odds.values()):
        raise ValueError("odds")
    rate = sharing.decode(parts["value_q1.bz2"], group, k)
    model = Model(graph, q0, odds["shared_odds.u32"].reshape(8, 7), rate, group, odds["value_odds.u32"].reshape(k, 7), tail, buckets_of(q0, BUCKET_EDGES))
    found = model.decode_support(parts["support.rans"], int(info["nnz"]))
    if found.n != info["nnz"]:
        raise ValueError("number of positives")
    row, at = found.of(np.arange(n))
    g, v = int(info["first"]) + found.g[at], model.decode_values(parts["values.rans"], found)[at]
    if digest_of(n, genes, np.concatenate([[0], np.cumsum(found.size)]), g, v) != info["canonical_sha256"]:
        raise ValueError("decoded counts")
    meta = bz2.decompress(parts["metadata.bz2"])
    if hashlib.sha256(meta).hexdigest() != info["metadata_sha256"]:
        raise ValueError("metadata")
    return row, g, v, json.loads(meta)


#: Positives and genes of a run.
SPAN = 500_000
#: Rows whose edges travel as one record.
CHUNK = 65_536


def by_run(study: Study, k: int, exceptions: bool, run: Callable[[tuple, Run], pa.Table], schema: str, span: int | None = None) -> DataFrame:
    """run(key, genes) of all runs of genes of every sample, by (sample_id, part)."""
    from ..sources.matrix import row_pointers
    from . import values

    m, prof = study.m, study.profiles(k)
    sizes = support.rows_per_sample(m).join(F.broadcast(m.genes.agg(F.count("*").alias("genes"))))
    span_of = F.greatest(F.lit(SPAN if span is None else span), F.lit(0) if span is not None else 2 * F.col("n")).cast("bigint")
    sized = few(sizes.select("sample_id", "n", "genes", span_of.alias("span")))
    every = m.genes.select("g").join(few(sizes.select("sample_id"))).select("sample_id", "g")
    place = row_pointers(m.counts, every, "g").join(sized, "sample_id").select("sample_id", "g", F.floor((F.col("ptr_lo") + F.col("g")) / F.col("span")).cast("int").alias("part"))
    place = materialise(place, "runs")
    parts = place.select("sample_id", "part").distinct()

    # Both sides hold ``place``, so their keys are named anew.
    own = [F.col(c).alias(c) for c in ("sample_id", "part")]

    def row(df: DataFrame, kind: int, **columns: str) -> DataFrame:
        other = {c: "bigint" for c in "abcde"} | {"x": "double", "y": "double", "t": "string", "edges": "array<struct<i:int,r:int,j:int>>"}
        return df.select(*own, F.lit(kind).alias("kind"), *[(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in other.items()])

    edge = F.struct(*[F.col(c).cast("int").alias(c) for c in "irj"])
    packed = study.graph.where(F.col("r") <= WIDTH).groupBy("sample_id", F.floor(F.col("i") / CHUNK).alias("_at")).agg(F.collect_list(edge).alias("edges")).drop("_at")
    # A graph of one row has no edges.
    none = m.spots.where("i = 0").select("sample_id", F.array().cast("array<struct<i:int,r:int,j:int>>").alias("edges"))
    genes = study.marginals().select("sample_id", "g", "q0").join(prof.select("sample_id", "g", "grp", "q"), ["sample_id", "g"]).join(place, ["sample_id", "g"]).join(m.genes, "g")
    if exceptions:
        genes = genes.join(study.exceptions(k).select("sample_id", "g", F.col("exception").cast("int").alias("kept")), ["sample_id", "g"])
    else:
        genes = genes.withColumn("kept", F.lit(-1))
    each = lambda df: df.join(parts, "sample_id")
    rest = [
        row(parts.join(sized, "sample_id"), SIZE, a="n", b="genes"), row(genes, GENE, a="g", b="q0", c="grp", d="q", e="kept", t="gene_id"), row(each(packed.unionByName(none)), EDGE, edges="edges"),
        row(each(values.centres(prof, k)), CENTRE, a="b", b="s"), row(each(study.support_odds()), SUPPORT, a="b", b="k", c="odds"), row(each(study.value_odds(k)), VALUE, a="b", b="c", c="odds"),
        row(each(study.tails(k).withColumn("k", F.col("c") * 32 + F.col("k"))), TAIL, a="b", b="k", c="freq"), row(m.spots.withColumn("part", F.lit(0)), SPOT, a="i", x="x", y="y", t="spot_id"),
    ]
    cells = m.counts.join(place, ["sample_id", "g"]).select(*own, F.col("i").cast("int").alias("i"), F.col("g").cast("int").alias("g"), "v")
    by = ("sample_id", "part")
    return cells.groupBy(*by).cogroup(reduce(DataFrame.unionByName, rest).groupBy(*by)).applyInArrow(lambda key, own, other: run(key, Run(own, other, k)), schema)


def round_trip(m: CountMatrix, k: int = 8, exceptions: bool = False, span: int | None = None) -> DataFrame:
    """(sample_id, support_bytes, value_bytes, support_bits, value_bits, exact, tight): both streams coded and decoded, over all runs of a sample's genes."""

    def run(key: tuple, s: Run) -> pa.Table:
        model, (wide, narrow) = s.model(), s.lanes()
        a, a_bits, a_coded = model.encode_support(s.found, wide)
        b, b_bits = model.encode_values(s.found, s.v, narrow)
        got = model.decode_support(a, s.found.n)
        back, at = model.decode_values(b, got), got.of(np.arange(s.n))[1]
        exact = (got.size == s.found.size).all() and (got.g[at] == s.found.g[: s.found.n]).all() and (back[at] == s.v).all()
        # A stream is as long as its symbols cost, but for its states.
        near = abs(8 * len(a) - a_coded - 32 * (wide + 1)) < 50 + 17 * wide and abs(8 * len(b) - b_bits - 32 * (narrow + 1)) < 50 + 17 * narrow
        one = {"sample_id": key[0].as_py(), "part": key[1].as_py(), "support_bytes": len(a), "value_bytes": len(b), "support_bits": a_bits, "value_bits": b_bits, "exact": bool(exact), "tight": bool(near)}
        return pa.table({c: [x] for c, x in one.items()}).set_column(1, "part", pa.array([one["part"]], pa.int32()))

    runs = by_run(Study(m), k, exceptions, run, "sample_id string, part int, support_bytes bigint, value_bytes bigint, support_bits double, value_bits double, exact boolean, tight boolean", span)
    # Doubles are added in one order.
    added = lambda c: F.aggregate(F.array_sort(F.collect_list(F.struct("part", c))), F.lit(0.0), lambda t, x: t + x[c]).alias(c)
    return runs.groupBy("sample_id").agg(F.sum("support_bytes").alias("support_bytes"), F.sum("value_bytes").alias("value_bytes"), added("support_bits"), added("value_bits"), F.bool_and("exact").alias("exact"), F.bool_and("tight").alias("tight"))


#: Bytes of a record of a stream that is hashed.
PIECE = 16_384


def digest(m: CountMatrix, part: int = PART) -> DataFrame:
    """(sample_id, digest): ``digest_of`` every sample. Parts are put in order and packed by tasks; a sample's bytes then stream through one hash, a few pieces at a time."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        head, _, genes, ptr, g, v = csr(rows)
        start, out = int(head["c"]), []
        if start == 0 and head["a"] == 0:
            out.append((0, 0, np.array([head["n"], genes, 0], "<u8").tobytes()))
        for section, x in ((1, start + ptr[1:]), (2, g), (3, v)):
            raw = np.asarray(x).astype("<u8").tobytes()
            out += [(section, at, raw[at : at + PIECE]) for at in range(0, len(raw), PIECE)]
        return pd.DataFrame({"sample_id": rows["sample_id"].iloc[0], "section": [x[0] for x in out], "first": int(head["a"]), "at": [x[1] for x in out], "raw": [x[2] for x in out]})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for p in batches:
            for sample, raw in zip(p["sample_id"], p["raw"], strict=True):
                if state is None or sample != name:
                    if state is not None:
                        yield pd.DataFrame({"sample_id": [name], "digest": [state.hexdigest()]})
                    name, state = sample, hashlib.sha256()
                state.update(raw)
        if state is not None:
            yield pd.DataFrame({"sample_id": [name], "digest": [state.hexdigest()]})

    pieces = sliced(m, part=part).groupBy("sample_id", "part").applyInPandas(pack, "sample_id string, section int, first bigint, at bigint, raw binary")
    return pieces.repartition("sample_id").sortWithinPartitions("sample_id", "section", "first", "at").select("sample_id", "raw").mapInPandas(hashed, "sample_id string, digest string")


def comparators(m: CountMatrix, part: int = PART) -> DataFrame:
    """(sample_id, method, bytes, exact): general compressors over compressed rows and columns, a stream for each part of a sample."""
    import zstandard

    def run(rows: pd.DataFrame, name: str) -> pd.DataFrame:
        _, _, _, ptr, minor, v = csr(rows, name == "CSR")
        raw, out = ptr.astype("<u8").tobytes() + minor.astype("<u4").tobytes() + v.astype("<u4").tobytes(), []
        for method, pack, unpack in (
            ("BZIP2_9", lambda x: bz2.compress(x, 9), bz2.decompress),
            ("ZLIB_9", lambda x: zlib.compress(x, 9), zlib.decompress),
            ("ZSTD_19", zstandard.ZstdCompressor(level=19).compress, zstandard.ZstdDecompressor().decompress),
        ):
            blob = pack(raw)
            out.append((rows["sample_id"].iloc[0], f"{name}_{method}", len(blob), unpack(blob) == raw))
        return pd.DataFrame(out, columns=["sample_id", "method", "bytes", "exact"])

    of = lambda name: sliced(m, name == "CSR", part).groupBy("sample_id", "part").applyInPandas(lambda rows: run(rows, name), "sample_id string, method string, bytes bigint, exact boolean")
    return of("CSR").unionByName(of("CSC")).groupBy("sample_id", "method").agg(F.sum("bytes").alias("bytes"), F.bool_and("exact").alias("exact"))
