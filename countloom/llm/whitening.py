"""Whitening of embeddings, with exact integer covariances by a digit-slice GEMM.

Entries become integers, x = floor(256 * entry). The fit list is each distinct x
vector once. With n of them and sums S, the centred vectors y = n * x - S are
integers as well; their products are added exactly: y is split into signed digits
of DIGIT bits, a matrix product of two digits over at most BLOCK rows stays below
2**53, so BLAS finds it exactly in doubles, and products are put together again as
big integers. A task sends the sum over its rows in pieces of 30 bits, which Spark
adds up; the driver puts d * d sums together (d: dimensions), divides by n ** 3, which
rounds once, and finds eigenvectors.

So the covariance does not depend on how rows are dealt out or in which order
they are added, and near-constant dimensions lose nothing to cancellation.

Defined cases: vectors that are null, empty, hold null or non-finite entries or entries
of more than 2**54, or are not of the commonest length (ties: the longer), take no
part; repeated rows each get their rows, and count once in the fit; a component without
variance has whitened null and takes no part in identity_error, which is null if there is
none; deviation is null where it exceeds a long, and deviation_text has it always; with
fewer than 4 dimensions there are as many components; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise

#: DIGIT + DIGIT + log2(BLOCK) <= 53, so that a sum of BLOCK products is exact in a double.
DIGIT, BLOCK = 20, 4096
#: Sums travel in pieces of so many bits: 2**33 tasks fit a long.
PIECE = 30
SCALE = 256.0


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): integer vectors of the rows that take part."""
    entries = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    fine = vectors.select(F.col(f"`{key}`").cast("bigint").alias(key), entries.alias("e")).where(F.size("e") > 0)
    fine = fine.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= 2.0**54)))
    top = fine.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return fine.where(F.size("e") == (top["d"] if top else 0)).select(key, F.transform("e", lambda c: F.floor(c * SCALE).cast("bigint")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in longs where these hold it, else in Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of DIGIT bits as doubles, the lowest first; as many as the largest entry needs."""
    sign, left, out = np.sign(y), abs(y), []
    while left.any():
        out.append((left & ((1 << DIGIT) - 1)).astype(np.float64) * sign.astype(np.float64))
        left = left >> DIGIT
    return out


def gram(y: np.ndarray) -> np.ndarray:
    """y' y as Python's integers, exactly."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for a in range(0, len(y), BLOCK):
        cut = digits(y[a : a + BLOCK])
        # Products of digits of the same weight are added in longs: at most 2**53 each, and some dozen of them.
        for weight in range(2 * len(cut) - 1):
            level = np.zeros((d, d), np.int64)
            for i in range(max(0, weight - len(cut) + 1), min(weight, len(cut) - 1) + 1):
                level += (cut[i].T @ cut[weight - i]).astype(np.int64)
            total += level.astype(object) << (DIGIT * weight)
    return total


def _pieces(values: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(position, piece, value) of integers; the sign goes with each piece."""
    at, piece, out = [], [], []
    for i, v in enumerate(values):
        sign, v, k = (-1 if v < 0 else 1), abs(v), 0
        while v:
            at.append(i)
            piece.append(k)
            out.append(sign * (v & ((1 << PIECE) - 1)))
            v >>= PIECE
            k += 1
    return at, piece, out


_SUMS = "at bigint, piece bigint, value bigint"


def _added(partial: DataFrame, size: int) -> list[int]:
    """Integers by position, put together of the pieces of all tasks."""
    out = [0] * size
    for r in partial.groupBy("at", "piece").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] += r["value"] << (PIECE * r["piece"])
    return out


def _batch(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("at", "piece", "value"), (pa.array(v, pa.int64()) for v in _pieces(values)), strict=True)))


def _sum_vectors(fit: DataFrame, d: int) -> list[int]:
    """n, then sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for b in batches:
            x = _matrix(b.column("x"), d)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            total = [t + v for t, v in zip(total, [len(x), *((int(h) << 32) + int(v) for h, v in zip(high, low, strict=True))], strict=True)]
        yield _batch(total)

    return _added(fit.mapInArrow(run, _SUMS), d + 1)


def _sum_products(fit: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """Sums of products of centred vectors."""
    d = len(sums)
    rows, columns = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for b in batches:
            total += gram(centred(_matrix(b.column("x"), d), n, sums))
        yield _batch(total[rows, columns].tolist())

    out = [[0] * d for _ in range(d)]
    for i, j, v in zip(rows.tolist(), columns.tolist(), _added(fit.mapInArrow(run, _SUMS), len(rows)), strict=True):
        out[i][j] = out[j][i] = v
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # (dimensions, components), unit columns
    trace: float

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened coordinates of centred vectors; nan where there is no variance."""
        scale = np.where(self.values > 0, self.values, np.nan)
        return (y / self.n).astype(np.float64) @ self.vectors / np.sqrt(scale)


def decompose(products: list[list[int]], n: int, sums: list[int], components: int) -> Whitening:
    """Eigenvectors of products / n ** 3; each division is of integers and rounds once."""
    cube = n**3
    cov = np.array([[v / cube for v in row] for row in products])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    # Either sign would do: an eigenvector's largest entry is positive, so that reruns agree.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = sum(products[i][i] for i in range(len(sums))) / cube
    # Rounding leaves variances of some 1e-16 of the largest where there are none.
    values = np.where(values > 1e-13 * max(trace, 0.0), values, 0.0)
    return Whitening(n, sums, values, vectors, trace)


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance less the identity, added up over the rows."""
    d, some = len(model.sums), np.flatnonzero(model.values > 0)
    k = len(some)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            # Centred already: their mean is that of y, which is 0 exactly.
            w = model.project(centred(_matrix(b.column("x"), d), model.n, model.sums))[:, some]
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(k * k), pa.int64()), "value": pa.array(total.ravel(), pa.float64())})

    got = {r["at"]: r["value"] for r in fit.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    return max(abs(got[i * k + j] / model.n - (i == j)) for i in range(k) for j in range(k))


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string"


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_text), a row for each row and component."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    schema = f"`{key}` bigint, {SCHEMA}"
    fit = materialise(rows.select("x").distinct(), "vectors")
    one = fit.first()
    if one is None:
        return spark.createDataFrame([], schema)
    d = len(one["x"])
    n, *sums = _sum_vectors(fit, d)
    model = decompose(_sum_products(fit, n, sums), n, sums, min(components, d))
    error = _identity_error(fit, model)
    discard(fit)
    k = len(model.values)
    share = model.values / model.trace if model.trace else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = centred(_matrix(b.column("x"), d), n, sums)
            big = y.dtype == object or d * int(abs(y).max()) ** 2 >= 1 << 63
            squares = ((y.astype(object) if big else y) ** 2).sum(1).tolist()
            w = model.project(y)
            each = lambda v, t: pa.array(np.repeat(np.array(v, object), k).tolist(), t)
            yield pa.RecordBatch.from_arrays(
                [
                    each(b.column(key).to_pylist(), pa.int64()), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()), pa.array(np.full(len(y) * k, n), pa.int64()),
                    each([s if s < 1 << 63 else None for s in squares], pa.int64()), pa.array(w.ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(share, len(y)), pa.float64()),
                    pa.array([error] * (len(y) * k), pa.float64()), each([str(s) for s in squares], pa.string()),
                ],
                [key, *(f.split()[0] for f in SCHEMA.split(", "))],
            )

    return rows.mapInArrow(run, schema)
