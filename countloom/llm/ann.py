"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Coarse centroids (k-means) cut space into cells; a vector is stored in its
nearest centroid's cell as its residual's product code (one byte for each group
of dimensions), with how far off the code is and the original behind it. A query
first meets the originals of the cells next to it, ``first`` vectors or more; the
(k + 1)-th nearest of these bounds what it is looking for. Then it looks into its
nearest ``probes`` cells, but for those that lie beyond its bound altogether (by
centroid and radius): a table of the squared distances from its residual to all
codewords turns codes into distances (asymmetric: the query is not quantised).
Codes farther than the bound by more than they are off cannot be neighbours; all
others are reranked exactly, on the original vectors in double precision. So the
result is exact within the cells looked into: codes never decide alone, ties and
near copies lose nothing, and no list has a cap.

``probes`` is found when the index is fitted: the least number of cells that hold
``recall`` of the sample's own neighbours. Vectors in clusters need few, and most
of these lie beyond the bound; vectors that fill all directions alike, as noise on
a sphere does, need more than half of them, and no index of this kind does better.

Codebooks are fitted on a bounded sample (``sample`` vectors, by hash); every
vector is indexed. The index is a file for each block of a cell, of at most about
``block`` vectors or BLOCK_BYTES, cut by a hash, so a cell that holds a third of all
vectors is as many files as it needs; queries of a cell are cut into blocks as well,
and a task reads one file for one block of queries. Cell counts and radii (at most
``cells`` rows) and file names are all the driver sees of the index.

Defined cases: vectors that are null, zero, or of null or non-finite components,
or not of the commonest length, and rows of null ids, take no part; each row is a
candidate and, where asked for, a query of its own, whether or not its id repeats;
of a query's candidates one of its own id and vector counts as itself; equal
vectors tie, to the smaller id; with too few candidates all are returned; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import attempt_name, discard, fresh_path, materialise, read_bytes, write_bytes

BLOCK_BYTES, SAMPLE_BYTES = 32 << 20, 64 << 20


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c**2).sum(1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.argmax(x[a : a + 4096] @ c.T - half, 1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centroids (fewer, if there are fewer distinct points)."""
    u = np.unique(x, axis=0)
    k = min(k, len(u))
    c = u[np.random.default_rng(seed).choice(len(u), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some]) / n[some, None]
    return c


@dataclass
class Codebook:
    coarse: np.ndarray  # (cells, dims)
    fine: list[np.ndarray]  # by group of dimensions: (codewords, dims of the group)
    probes: int = 1

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([0, *(f.shape[1] for f in self.fine)]).tolist()

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, groups: int = 16, recall: float = 0.97, k: int = 10, asked: int = 400) -> Codebook:
        coarse = kmeans(x, cells)
        cell = _nearest(x, coarse)
        rest = x - coarse[cell]
        book = cls(coarse, [kmeans(part, 256, 8) for part in np.array_split(rest, min(groups, x.shape[1]), axis=1)])
        # In how many cells, nearest first, the sample's own neighbours are found.
        q = np.random.default_rng(5).choice(len(x), min(asked, len(x)), replace=False)
        ranks = []
        for a in range(0, len(q), 100):
            own = q[a : a + 100]
            d = (x**2).sum(1) - 2 * x[own] @ x.T
            d[np.arange(len(own)), own] = np.inf
            near = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, : min(k, len(x) - 1)]
            ranks.append(np.take_along_axis(book.order(x[own]).argsort(1), cell[near], 1).ravel())
        ranks = np.sort(np.concatenate(ranks)) if ranks else np.empty(0, np.int64)
        book.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1
        return book

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells of each query, nearest first."""
        return ((self.coarse**2).sum(1) - 2 * q @ self.coarse.T).argsort(1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, how far off the codes are, distance from the centroid)."""
        cell = _nearest(x, self.coarse)
        rest, cuts = x - self.coarse[cell], self.cuts
        codes = np.stack([_nearest(rest[:, a:b], f) for a, b, f in zip(cuts, cuts[1:], self.fine, strict=False)], 1).astype(np.uint8)
        near = np.concatenate([f[codes[:, j]] for j, f in enumerate(self.fine)], 1)
        return cell, codes, np.sqrt(((rest - near) ** 2).sum(1)), np.sqrt((rest**2).sum(1))

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of a cell."""
        rest, cuts = q - self.coarse[cell], self.cuts
        out = np.zeros((len(q), len(codes)), np.float32)
        for j, (a, b, f) in enumerate(zip(cuts, cuts[1:], self.fine, strict=False)):
            table = ((rest[:, None, a:b] - f) ** 2).sum(2).astype(np.float32)
            out += table[:, codes[:, j]]
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, row): the rows that take part; see the module."""
    v = F.col(vec_col)
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ).withColumn("row", F.monotonically_increasing_id())


def _matrix(b, column: str, dims: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _exact(x: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs (i of q, j of x), summed term by term."""
    total = np.zeros(len(i))
    for a in range(0, len(i), 100_000):
        p, r = i[a : a + 100_000], j[a : a + 100_000]
        for c in range(x.shape[1]):
            total[a : a + 100_000] += (x[r, c] - q[p, c]) ** 2
    return np.sqrt(total)


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, queries: int, k: int) -> np.ndarray:
    """Places of each query's k least scores, ties to the smaller id."""
    order = np.lexsort((ids, score, i))
    n = np.bincount(i, minlength=queries)
    return order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < k]


class _Index:
    """What tasks need to know of the index."""

    def __init__(self, book: Codebook, dims: int, files: list):
        self.book, self.dims = book, dims
        cells = len(book.coarse)
        self.held, self.radius = np.zeros(cells, np.int64), np.zeros(cells)
        self.files: list[list[str]] = [[] for _ in range(cells)]
        for r in sorted(files):
            self.held[r["cell"]] += r["n"]
            self.radius[r["cell"]] = max(self.radius[r["cell"]], r["radius"])
            self.files[r["cell"]].append(r["uri"])

    def look(self, found: DataFrame, k: int, query_block: int, by_code: bool) -> DataFrame:
        """(row, query_id, vec_id, score): the nearest, by block, of queries (row, query_id, q, bound, cell)."""
        book, dims, files = self.book, self.dims, self.files
        spark = found.sparkSession
        asked = {r["cell"]: r["count"] for r in found.groupBy("cell").count().collect()}
        blocks = spark.createDataFrame([(c, b, int(-(-n // query_block))) for c, n in asked.items() for b in range(len(files[c]))] or [(-1, 0, 1)], "cell int, b int, nq int")
        dealt = found.join(F.broadcast(blocks), "cell").withColumn("qb", F.pmod(F.xxhash64("row"), F.col("nq")).cast("int")).drop("nq")

        def run(group: pa.Table) -> pa.Table:
            cell, b = group.column("cell")[0].as_py(), group.column("b")[0].as_py()
            with np.load(io.BytesIO(read_bytes(files[cell][b]))) as z:
                ids, x, codes, off = z["ids"], z["x"], z["codes"], z["off"]
            x = x.astype(np.float64)
            xx = (x**2).sum(1)
            q = np.frombuffer(b"".join(group.column("q").to_pylist())).reshape(-1, dims)
            bound = group.column("bound").to_numpy()
            out = []
            step = max(1, 4_000_000 // len(ids))
            for a in range(0, len(q), step):
                some, upto = q[a : a + step], bound[a : a + step]
                slack = 1e-4 * (np.sqrt(xx.max()) + np.sqrt((some**2).sum(1)))
                if by_code:
                    i, j = np.nonzero(np.sqrt(book.distances(some, cell, codes)) - off <= (upto + slack)[:, None])
                else:
                    rough = xx + (some**2).sum(1)[:, None] - 2 * some @ x.T
                    if len(ids) > k:
                        rough -= np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero(rough <= (1e-9 * (xx.max() + (some**2).sum(1)))[:, None] if len(ids) > k else np.isfinite(rough))
                score = _exact(x, some, i, j)
                ok = score <= upto[i]
                i, j, score = i[ok], j[ok], score[ok]
                at = _best(i, ids[j], score, len(some), k)
                out.append((a + i[at], ids[j[at]], score[at]))
            i, near, score = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.table([group.column("row").take(pa.array(i)), group.column("query_id").take(pa.array(i)), pa.array(near), pa.array(score)], ["row", "query_id", "vec_id", "score"])

        return dealt.groupBy("cell", "b", "qb").applyInArrow(run, "row bigint, query_id bigint, vec_id bigint, score double")


def build(base: DataFrame, dims: int, total: int, cells: int = 2048, recall: float = 0.97, k: int = 10, sample: int = 40_000, block: int = 50_000) -> _Index:
    """Indexes rows (vec_id, v, row) of one length."""
    spark = base.sparkSession
    sample, block = min(sample, SAMPLE_BYTES // (8 * dims)), max(1, min(block, BLOCK_BYTES // (8 * dims)))
    u = F.shiftrightunsigned(F.xxhash64("row", F.lit("ann")), 11) / F.lit(float(1 << 53))
    some = base.select("row", "v")
    drawn = some.where(u < min(1.0, sample / total)).toArrow()
    drawn = (drawn if drawn.num_rows else some.limit(1).toArrow()).sort_by("row").combine_chunks()
    x = _matrix(drawn.to_batches()[0], "v", dims)
    # A cell needs some points of the sample to be placed well.
    book = Codebook.fit(x, max(1, min(cells, int(total**0.5), len(x) // 8)), recall=recall, k=k)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b, "v", dims)
                cell, codes, off, far = book.encode(v)
                single = (v.astype(np.float32) == v).all()
                raw = [r.tobytes() for r in (v.astype(np.float32) if single else v)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("row"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(far), pa.array(raw, pa.binary())],
                    ["vec_id", "row", "cell", "code", "off", "far", "raw"],
                )

    coded = materialise(base.mapInArrow(encode, "vec_id bigint, row bigint, cell int, code binary, off double, far double, raw binary"), "coded")
    counts = spark.createDataFrame([(r["cell"], int(-(-r["count"] // block))) for r in coded.groupBy("cell").count().collect()], "cell int, nb int")
    where = fresh_path(spark, "ivf")

    def write(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        raw, ids = group.column("raw").to_pylist(), group.column("vec_id").to_numpy()
        x = np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dims else np.float64) for r in raw])
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        out = io.BytesIO()
        np.savez(out, ids=ids, x=x, codes=codes, off=group.column("off").to_numpy())
        uri = f"{where}/{attempt_name(cell)}.npz"
        write_bytes(uri, out.getvalue())
        return pa.table({"cell": pa.array([cell], pa.int32()), "uri": [uri], "n": [len(ids)], "radius": [float(group.column("far").to_numpy().max())]})

    dealt = coded.join(F.broadcast(counts), "cell").withColumn("b", F.pmod(F.xxhash64("row"), F.col("nb")).cast("int")).drop("nb")
    files = dealt.groupBy("cell", "b").applyInArrow(write, "cell int, uri string, n bigint, radius double").collect()
    discard(coded)
    return _Index(book, dims, files)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    cells: int = 2048, recall: float = 0.97, first: int = 400, sample: int = 40_000, block: int = 50_000, query_block: int = 2_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score). queries: rows of the same columns."""
    spark = vectors.sparkSession
    base = materialise(usable(vectors, id_col, vec_col), "vectors")
    lengths = {r["n"]: r["count"] for r in base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()}
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    (dims, total), = lengths.items()
    index = build(base.where(F.size("v") == dims), dims, total, cells, recall, k, sample, block)
    discard(base)
    asked = materialise(usable(queries, id_col, vec_col).where(F.size("v") == dims).withColumnRenamed("vec_id", "query_id"), "queries")
    book, held, radius = index.book, index.held, index.radius
    routes = "row bigint, query_id bigint, q binary, bound double, cell int"

    def rows(b: pa.RecordBatch, v: np.ndarray, keep: np.ndarray, order: np.ndarray, bound: pa.Array) -> pa.RecordBatch:
        at, rank = np.nonzero(keep)
        take = pa.array(at)
        raw = pa.array([r.tobytes() for r in v], pa.binary())
        return pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("query_id").take(take), raw.take(take), bound.take(take), pa.array(order[at, rank].astype(np.int32))], ["row", "query_id", "q", "bound", "cell"])

    def nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b, "v", dims)
                order = book.order(v)
                upto = np.cumsum(held[order], 1) - held[order]
                yield rows(b, v, (upto < max(first, k + 1)) & (held[order] > 0), order, pa.array(np.full(len(v), np.inf)))

    def all_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, bound = _matrix(b, "v", dims), b.column("bound").to_numpy()
                order = book.order(v)
                far = np.sqrt(np.maximum(0, (v**2).sum(1)[:, None] + (book.coarse**2).sum(1) - 2 * v @ book.coarse.T))
                slack = 1e-6 * (1 + np.sqrt((v**2).sum(1)) + np.sqrt((book.coarse**2).sum(1).max()))
                within = np.take_along_axis(far - radius, order, 1) <= (bound + slack)[:, None]
                # Where the nearest cells hold too few vectors, a query goes on until it has enough.
                upto = np.cumsum(held[order], 1) - held[order]
                probed = (np.arange(len(held)) < book.probes) | (upto < max(first, k + 1))
                yield rows(b, v, probed & within & (held[order] > 0), order, b.column("bound"))

    near = materialise(asked.mapInArrow(nearby, routes), "routes")
    by_row = W.partitionBy("row").orderBy("score", "vec_id")
    bounds = index.look(near, k + 1, query_block, False).withColumn("r", F.row_number().over(by_row)).where(F.col("r") == k + 1).select("row", F.col("score").alias("bound"))
    bounded = materialise(asked.join(bounds, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "bounded")
    probing = materialise(bounded.mapInArrow(all_probes, routes), "routes")
    found = index.look(probing, k + 1, query_block, True).withColumn("r", F.row_number().over(by_row)).where(F.col("r") <= k + 1)
    # One candidate of the query's own id and vector is the query itself.
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    itself = F.min(F.when(own, F.col("r"))).over(W.partitionBy("row"))
    ranked = found.withColumn("_own", itself).where(F.col("_own").isNull() | (F.col("r") != F.col("_own")))
    ranked = ranked.withColumn("rank", (F.col("r") - F.when(F.col("_own") < F.col("r"), 1).otherwise(0)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
