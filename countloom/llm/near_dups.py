"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A document is a bag of shingles of five words (fewer than five, but not none: one
shingle of all), lower-cased, letters and digits only. A shingle weighs
(1 + ln tf) * (1 + ln(N / max(df, 1, N * FLOOR))): TF-IDF, but that what stands in less
than FLOOR of all documents is as rare as can be. So the table of other shingles has
at most (shingles a document) / FLOOR rows however large the corpus is, and weights
do not drift with its size; up to 1 / FLOOR documents it is TF-IDF as it stands. These
shingles are found by a hashed count of all and then counted exactly, over all
documents.

1. Texts of equal words collapse into one node (128 bits of hash), so copies cost
   no more than one document. Nodes get a number; all later steps are on numbers.
2. Improved consistent weighted sampling (Ioffe, 2010) draws SAMPLES samples a
   node, alike in two nodes with the probability of their weighted Jaccard
   similarity. Its random triples come from a fixed pool; nearly all shingles have
   one and the same weight, for which the pool is sorted by the value to be
   minimised, so the sample is the least hash.
3. Bands of ROWS samples are buckets. In the first bands' buckets every member is
   compared with one leader (the least hash for that bucket), which links most of
   what there is to link; links are merged into components.
4. A bucket, of any band, whose members are then in one component is done. If not,
   links between its components are looked for: in one list of at most SMALL
   members, or in parts of which every two make a list. A pair is looked at in one
   band only; pairs whose samples agree too seldom (a pair at the threshold does so
   with a probability of LOSS), or which links have joined meanwhile, are not
   verified; only links leave a task. A bucket beyond HUGE is split by ROWS more
   samples, in TABLES ways (which miss fewer pairs than the bands do), and goes
   through 3 and 4 again. No partner or candidate is left out by a cap.
5. Similarity is verified exactly, on the whole bags, and must reach THRESHOLD.

Components come from alternating large and small stars (Kiveris et al., 2014) over
tables in the shared folder; neither links nor components ever meet in one task or
at the driver.

Defined cases: null and word-less texts are classes of their own; repeated rows
are copies of each other; a class without any doc_id has a null id; an empty table
gives no rows; extra columns are ignored, or kept where documents are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, materialise
from .words import ALNUM, Words, mix, pieces, planes, shingles, unplanes, words

THRESHOLD = 0.8
FLOOR = 0.001
#: Counters, as a power of two, that find frequent shingles; and how many travel in a row.
SKETCH, SLICE = 20, 4096
ROWS = 3
BANDS = 14
SAMPLES = ROWS * BANDS
#: Members and bytes of bags up to which a bucket is one list, and beyond which it is split.
SMALL, SMALL_BYTES = 2048, 24 << 20
HUGE, HUGE_BYTES = 16_384, 256 << 20
#: How often, at most, the samples of a pair at the threshold agree too seldom for it to be verified.
LOSS = 1e-5
#: Rounds, at most, of splitting huge buckets.
LEVELS = 4
TABLES = 20
POOL = 1 << 16


def agree(threshold: float, loss: float = LOSS) -> int:
    """The most samples that a pair of this similarity shares with a probability of at least 1 - loss."""
    p, below = [math.comb(SAMPLES, k) * threshold**k * (1 - threshold) ** (SAMPLES - k) for k in range(SAMPLES + 1)], 0.0
    for k in range(SAMPLES + 1):
        below += p[k]
        if below > loss:
            return k
    return SAMPLES


def node_keys(w: Words) -> np.ndarray:
    """16 bytes for each row's sequence of words, as rows of two uint64; zero for none."""
    n = np.diff(w.first)
    out = np.zeros((len(n), 2), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        place = (np.arange(len(w.hash)) - w.first[w.row]).astype(np.uint64)
        for c, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            each = mix((w.hash ^ np.uint64(salt >> 1)) + mix((place + np.uint64(1)) * np.uint64(salt)))
            out[some, c] = np.add.reduceat(each, w.first[some]) | np.uint64(c == 0)
    return out


def _binary(keys: np.ndarray, none: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(keys.astype(">u8")).tobytes()
    return pa.array([None if z else raw[16 * i : 16 * i + 16] for i, z in enumerate(none.tolist())], pa.binary())


def bags(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, tf), ascending by row, then shingle."""
    h, r = shingles(w, 5)
    order = np.argsort(h, kind="stable")
    h, r = h[order], r[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.empty(0, np.int64)
    tf = np.diff(np.concatenate([new, [len(h)]]))
    h, r = h[new], r[new]
    order = np.argsort(r.astype(np.uint16) if len(w.first) <= 1 << 16 else r, kind="stable")
    return h[order], r[order], tf[order]


def frequent_shingles(docs: DataFrame, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles ascending, their document counts, documents) of those in at least ``floor`` of all documents and in more than one.

    A shingle's counter is at least its count, so only shingles whose counters reach
    the floor are counted one by one.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(1 << SKETCH, np.int64), 0
        for b in pieces(batches, "text"):
            w = words(b.column("text"), ALNUM)
            n += np.bincount((bags(w)[0] >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH)
            rows += int((np.diff(w.first) > 0).sum())
        if rows:
            parts = n.reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([rows] * len(parts), pa.int64()), pa.array([planes(x) for x in parts], pa.binary())], ["slice", "rows", "n"])

    def add(group: pa.Table) -> pa.Table:
        n = sum(unplanes(x.as_buffer(), SLICE) for x in group.column("n"))
        return pa.table([group.column("slice").slice(0, 1).combine_chunks().cast(pa.int32()), pa.array([sum(group.column("rows").to_pylist())], pa.int64()), pa.array([planes(n)], pa.binary())], ["slice", "rows", "n"])

    form = "slice int, rows bigint, n binary"
    found = docs.select("text").mapInArrow(sketch, form).groupBy("slice").applyInArrow(add, form).collect()
    total = found[0]["rows"] if found else 0
    least = max(2.0, floor * total)
    some = np.zeros(1 << SKETCH, bool)
    for r in found:
        some[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = unplanes(r["n"], SLICE) >= least
    marked = np.packbits(some)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.unpackbits(marked).astype(bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def leave() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held]), len(h)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for b in pieces(batches, "text"):
            h = bags(words(b.column("text"), ALNUM))[0]
            held.append(np.unique(h[reach[(h >> np.uint64(64 - SKETCH)).astype(np.int64)]], return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                yield leave()
                held, size = [], 0
        if held:
            yield leave()

    if not some.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64), total
    # At most (shingles a document) / floor rows of 16 bytes, as columns.
    rows = docs.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order], total


class Weights:
    """Weights of shingles, and the sampler's pool for the commonest weight."""

    def __init__(self, shingle: np.ndarray, count: np.ndarray, total: int, floor: float = FLOOR):
        self.shingle = shingle
        self.most = 1 + np.log(max(total, 1) / max(1.0, floor * total))
        self.idf = np.minimum(1 + np.log(max(total, 1) / np.maximum(count, 1)), self.most)
        r = np.random.default_rng(2010)
        rate, scale, shift = r.gamma(2, 1, POOL), r.gamma(2, 1, POOL), r.random(POOL)
        step, value = self._draw(np.log(self.most), rate, scale, shift)
        order = np.argsort(value, kind="stable")
        self.rate, self.scale, self.shift, self.step, self.value = rate[order], scale[order], shift[order], step[order], value[order]
        self.odd = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    @staticmethod
    def _draw(log_weight, rate, scale, shift):
        step = np.floor(log_weight / rate + shift)
        return step, np.log(scale) - rate * (step - shift) - rate

    def of(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), self.most)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, h), len(self.shingle) - 1)
            hit = self.shingle[at] == h
            idf[hit] = self.idf[at[hit]]
        return idf * (1 + np.log(tf))

    def samples(self, h: np.ndarray, r: np.ndarray, tf: np.ndarray, rows: int) -> np.ndarray:
        """int32 samples (rows, SAMPLES) of bags ascending by row; rows without shingles get 0."""
        weight = self.of(h, tf)
        usual = weight == self.most
        hu, ru = h[usual], r[usual]
        starts = np.flatnonzero(np.concatenate([[True], ru[1:] != ru[:-1]])) if len(ru) else np.empty(0, np.int64)
        at_u = ru[starts]
        ho, ro, lo = h[~usual], r[~usual], np.log(weight[~usual])
        starts_o = np.flatnonzero(np.concatenate([[True], ro[1:] != ro[:-1]])) if len(ro) else np.empty(0, np.int64)
        sizes_o = np.diff(np.concatenate([starts_o, [len(ro)]])).astype(np.int64)
        out = np.zeros((rows, SAMPLES), np.int32)
        for j in range(SAMPLES):
            best = np.full(rows, np.inf)
            code = np.zeros(rows, np.uint64)
            if len(hu):
                x = hu * self.odd[j]
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                low = np.minimum.reduceat(x, starts)
                place = (low >> np.uint64(48)).astype(np.int64)
                best[at_u] = self.value[place]
                code[at_u] = low ^ mix(self.step[place].astype(np.int64).view(np.uint64) + np.uint64(7))
            if len(ho):
                x = ho * self.odd[j]
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                place = (x >> np.uint64(48)).astype(np.int64)
                step, value = self._draw(lo, self.rate[place], self.scale[place], self.shift[place])
                # The least value of each row; of equal ones, the least hash.
                low = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts_o), sizes_o))
                ends = np.flatnonzero(np.concatenate([[True], ro[low][1:] != ro[low][:-1]]))
                x_low = np.minimum.reduceat(x[low], ends)
                first = low[x[low] == np.repeat(x_low, np.diff(np.concatenate([ends, [len(low)]])))]
                first = first[np.concatenate([[True], ro[first][1:] != ro[first][:-1]])]
                better = value[first] < best[ro[first]]
                first = first[better]
                code[ro[first]] = x[first] ^ mix(step[first].astype(np.int64).view(np.uint64) + np.uint64(7))
            out[:, j] = (mix(code) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, key, sig): key is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = words(b.column("text"), ALNUM)
            sig = weights.samples(*bags(w), b.num_rows)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, SAMPLES, dtype=np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), _binary(node_keys(w), np.diff(w.first) == 0), flat], ["doc_id", "key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, key binary, sig array<int>")


_NO_ID = -(1 << 63)


def payloads(docs: DataFrame, chosen: DataFrame, weights: Weights) -> DataFrame:
    """(node, h, w): the bags of the chosen nodes (node, doc_id, key); each is made from one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = words(b.column("text"), ALNUM)
            own = _binary(node_keys(w), np.diff(w.first) == 0).to_pylist()
            h, r, tf = bags(w)
            weight = weights.of(h, tf)
            plain = weight == weights.most
            weight = weight.astype(np.float32)
            cut = np.searchsorted(r, np.arange(b.num_rows + 1))
            # Rows of one id may have different texts; only the one asked for counts.
            rows = [i for i, k in enumerate(b.column("key").to_pylist()) if k == own[i]]
            yield pa.RecordBatch.from_arrays(
                [b.column("node").take(pa.array(rows, pa.int64())), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([b"" if plain[cut[i] : cut[i + 1]].all() else weight[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary())],
                ["node", "h", "w"],
            )

    # Ids grow with the corpus, so texts meet them by a shuffle, at every size the same way.
    ids = chosen.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "key", "node").hint("merge")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"), "text").join(ids, "id")
    return texts.select("node", "key", "text").mapInArrow(run, "node bigint, h binary, w binary").dropDuplicates(["node"])


def _bag(h: bytes, w: bytes, usual: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and weights; no weights stand for the usual one throughout."""
    h = np.frombuffer(h, np.uint64)
    return h, np.frombuffer(w, np.float32) if w else np.full(len(h), usual, np.float32)


def _similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    if len(ha) > len(hb):
        ha, hb, wa, wb = hb, ha, wb, wa
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    ok = hb[at] == ha
    both = float(np.minimum(wa[ok], wb[at[ok]]).sum(dtype=np.float64))
    return both / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both)


def verify(pairs: DataFrame, bag: DataFrame, usual: float, threshold: float) -> DataFrame:
    """(a, b, linked) of the pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = [_similarity(*_bag(ha, wa, usual), *_bag(hb, wb, usual)) for ha, wa, hb, wb in zip(*(b.column(c).to_pylist() for c in ("ha", "wa", "hb", "wb")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(np.array(sim) >= threshold - 1e-9)], ["a", "b", "linked"])

    left = bag.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    right = bag.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(run, "a bigint, b bigint, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with edges (a, b); comp is the least node of the component."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(edges)
        edges, before = after, state
        state = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            break
    # All edges are now from nodes to their component's least node.
    found = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "components")
    discard(edges)
    return found


def _buckets(nodes: DataFrame, bands: list[tuple[int, ...]], extra: list[str]) -> DataFrame:
    """(band, bucket, node): a row for each node and band."""
    each = [F.xxhash64(*extra, F.lit(i), *[F.element_at("sig", p + 1) for p in band]) for i, band in enumerate(bands)]
    return nodes.select("node", F.posexplode(F.array(*each)).alias("band", "bucket"))


def _with_comp(df: DataFrame, links: DataFrame | None, node: str, name: str) -> DataFrame:
    if links is None:
        return df.withColumn(name, F.col(node))
    return df.join(links.select(F.col("node").alias(node), F.col("comp").alias("_c")), node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")


def _agreeing(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """The pairs whose samples agree often enough for the threshold."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, t: s + t)
    return both.where(same >= least).select("a", "b")


def _within(lists: DataFrame, bands: list[tuple[int, ...]], usual: float, threshold: float) -> DataFrame:
    """(a, b): links that join different components within lists (band, m) of members (node, comp, sig, h, w).

    A pair that meets in several bands is looked at in the first. Pairs whose samples
    agree too seldom, or whose weights differ too much, are below the threshold; of
    the others, those that links found so far have joined need not be verified. So a
    list gives fewer links than it has members.
    """
    order, least = np.array(bands), agree(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, members in zip(batch.column("band").to_pylist(), batch.column("m"), strict=True):
                members = members.as_py()
                sig = np.array([m["sig"] for m in members], np.int32)
                bag = [_bag(m["h"], m["w"], usual) for m in members]
                total = np.array([float(w.sum(dtype=np.float64)) for _, w in bag])
                seen: dict[int, int] = {}
                root = [seen.setdefault(m["comp"], i) for i, m in enumerate(members)]
                a, b = [], []

                def find(x: int) -> int:
                    while root[x] != x:  # noqa: B023
                        root[x] = root[root[x]]  # noqa: B023
                        x = root[x]  # noqa: B023
                    return x

                for i in range(1, len(members)):
                    equal = sig[:i] == sig[i]
                    same = equal.sum(1)
                    near = np.flatnonzero((same >= least) & (np.minimum(total[:i], total[i]) >= (threshold - 1e-6) * np.maximum(total[:i], total[i])))
                    if not len(near):
                        continue
                    near = near[equal[near][:, order].all(2).argmax(1) == band]
                    for j in near[np.argsort(-same[near], kind="stable")].tolist():
                        p, q = find(i), find(j)
                        if p != q and _similarity(*bag[i], *bag[j]) >= threshold - 1e-9:
                            root[max(p, q)] = min(p, q)
                            a.append(members[i]["node"])
                            b.append(members[j]["node"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lists.select("band", "m").mapInArrow(run, "a bigint, b bigint").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, comp, class_id, class_size), one row per document row; class_id is the least doc_id of the class.

    key names the document's words and comp its class; both are null without words.
    """
    weights = Weights(*frequent_shingles(docs))
    usual, least = float(weights.most), agree(threshold)
    made: list[DataFrame] = []

    def put(df: DataFrame, tag: str) -> DataFrame:
        made.append(materialise(df, tag))
        return made[-1]

    sig = materialise(signatures(docs, weights), "signatures")
    nodes = put(sig.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = [tuple(range(i, i + ROWS)) for i in range(0, SAMPLES, ROWS)]
    rows = _buckets(nodes, bands, [])
    links = bag = None
    picks = np.random.default_rng(14)

    def merge(found: DataFrame) -> None:
        nonlocal links
        found = put(found, "links")
        if links is None or not found.isEmpty():
            links = components(found if links is None else links.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found))
            made.append(links)

    for level in range(LEVELS):
        counts = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("node", "bucket")).alias("leader")).where("members > 1")
        rows = put(rows.join(counts, "bucket"), "buckets")
        if bag is None:
            chosen = put(rows.select("node").distinct().join(nodes, "node").select("node", "key", "doc_id", "sig"), "chosen")
            plain = put(payloads(docs, chosen, weights), "bags")
            bag = put(plain.join(chosen.select("node", "sig"), "node"), "bags")
            sigs = bag.select("node", "sig")
        # A few bands, against one leader a bucket, link most of what there is to link.
        apart = _with_comp(_with_comp(rows.where((F.col("band") < 2) & (F.col("node") != F.col("leader"))), links, "node", "comp"), links, "leader", "other").where("comp <> other")
        pairs = _agreeing(apart.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct(), sigs, least)
        merge(verify(pairs, bag, usual, threshold).where("linked").select("a", "b"))
        known = _with_comp(rows, links, "node", "comp").join(bag.select("node", (F.length("h") + F.length("w")).alias("size")), "node")
        mixed = known.groupBy("bucket", "band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("whole"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        # Bands often give the same bucket; the first of each is enough.
        mixed = mixed.groupBy("n", "bytes", "whole").agg(F.min("band").alias("band"), F.min_by("bucket", "band").alias("bucket"))
        known = put(known.select("bucket", "node", "comp").join(mixed, "bucket"), "mixed")
        last = level == LEVELS - 1
        huge = F.lit(False) if last else (F.col("n") > HUGE) | (F.col("bytes") > HUGE_BYTES)
        # A bucket that is too much for one list goes in parts, every two of them as one list.
        parts = F.ceil(F.greatest(F.lit(1.0), F.when((F.col("n") > SMALL) | (F.col("bytes") > SMALL_BYTES), F.greatest(F.col("n") * 2 / SMALL, F.col("bytes") * 2 / SMALL_BYTES)).otherwise(1.0))).cast("int")
        own = known.where(~huge).withColumn("of", parts).withColumn("p", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
        each = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("of") - 1)))).where("p <> o or of = 1")
        lists = each.select("band", F.xxhash64("bucket", F.least("p", "o"), F.greatest("p", "o")).alias("bucket"), "node", "comp")
        gathered = lists.join(bag, "node").groupBy("bucket", "band").agg(F.collect_list(F.struct("node", "comp", "sig", "h", "w")).alias("m"))
        merge(_within(gathered, bands, usual, threshold))
        large = known.where(huge)
        if last or large.isEmpty():
            break
        up = large.select(F.col("bucket").alias("up"), "node").join(sigs, "node")
        bands = [tuple(int(p) for p in picks.choice(SAMPLES, ROWS, replace=False)) for _ in range(TABLES)]
        rows = _buckets(up, bands, ["up"])
    of = _with_comp(nodes.select("node", "key", "doc_id", "n"), links, "node", "comp")
    ids = of.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = materialise(of.select("key", "comp").join(ids, "comp").select("key", "comp", "class_id", "class_size"), "classes")
    discard(*made)
    out = sig.select("doc_id", "key").join(named, "key", "left")
    alone = F.col("key").isNull()
    return out.select("doc_id", "key", "comp", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"))


_LAST_ID = (1 << 63) - 1


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, without near duplicates: of each class one row of its least doc_id stays.

    Rows without words stay. A null doc_id is the greatest.
    """
    found = classes(docs, threshold).where(F.col("key").isNotNull()).select(F.coalesce("doc_id", F.lit(_LAST_ID)).alias("_countloom_id"), F.col("key").alias("_countloom_key"), "comp")
    per = found.groupBy("comp", "_countloom_id", "_countloom_key").agg(F.count("*").alias("_n"))
    best = per.groupBy("comp").agg(F.min(F.struct("_countloom_id", "_countloom_key", "_n")).alias("b")).select("b._countloom_id", "b._countloom_key", (F.col("b._n") > 1).alias("_countloom_more"))
    best = materialise(best, "kept")
    more = not best.where("_countloom_more").isEmpty()
    near = best.hint("merge")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = words(b.column("text"), ALNUM)
            ids = b.column("doc_id").cast(pa.int64()).fill_null(_LAST_ID)
            yield pa.RecordBatch.from_arrays([*b.columns, ids, _binary(node_keys(w), np.diff(w.first) == 0)], [*columns, "_countloom_id", "_countloom_key"])

    # Lists, as add() changes a schema in place.
    schema = T.StructType([*docs.schema.fields, T.StructField("_countloom_id", T.LongType()), T.StructField("_countloom_key", T.BinaryType())])
    keyed = docs.mapInArrow(run, schema).join(near, ["_countloom_id", "_countloom_key"], "left").where(F.col("_countloom_key").isNull() | F.col("_countloom_more").isNotNull())
    if more:  # equal rows of one id; only these are shuffled
        keyed = keyed.where(F.col("_countloom_key").isNull() | ~F.col("_countloom_more")).select(*columns).union(keyed.where("_countloom_more").dropDuplicates(["_countloom_id", "_countloom_key"]).select(*columns))
    return keyed.select(*columns)
