"""Causal neighbour graphs: for every row, some earlier rows.

``graph(sample_id, i, r, j)`` has r = 1..min(i, width) and j < i.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.matrix import few
from ..sources.shared import materialise
from .layout import permutation
from .quantiles import quantiles
from .scan import scan


def _top(pairs: DataFrame, width: int) -> DataFrame:
    w = W.partitionBy("sample_id", "i").orderBy("d2", "j")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= width)


def _epoch(row: Column) -> Column:
    """floor(log4(row)) by binary digits, so exact; EPOCH at least."""
    return F.greatest(F.floor((F.length(F.bin(F.greatest(row, F.lit(1)))) - 1) / 2), F.lit(EPOCH)).cast("int")


def _spread(v: Column) -> Column:
    """The 31 bits of a number at every second place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    """Code of a place whose coordinates are scaled to 0..1."""
    whole = lambda c: F.floor(c * F.lit(float((1 << 31) - 1))).cast("bigint")
    return _spread(whole(x)).bitwiseOR(F.shiftleft(_spread(whole(y)), 1))


#: Rows of a tile; half are candidates, half ask. Rows before 4 ** (EPOCH + 1) make one tile.
TILE, EPOCH = 2048, 4
#: Asking rows that are held against a tile's candidates at a time, so that distances stay in a processor's cache.
ASKS = 64
#: A tile's box is 56 bytes, and those of a sample and epoch go along with a tile.
MOST_TILES = 1 << 16
#: Tiles that share a copy of the boxes.
SHARE = 64


def _tiles(spots: DataFrame, width: int, tile: int) -> DataFrame:
    """(sample_id, e, tile, rows, x0, x1, y0, y1, least, enough): runs of ``tile`` rows along a Morton curve.

    rows: struct<asks, i, x, y>; the box and the rest are of its candidates: the least row, and
    the ``width``-th one.
    """
    box = spots.groupBy("sample_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.max("i").alias("last"))
    at = lambda c, side: F.when(F.col(side) > 0, (F.col(c) - F.col(f"{c}0")) / F.col(side)).otherwise(0.0)
    placed = spots.select("sample_id", "i", "x", "y").join(few(box), "sample_id").withColumn("code", morton(at("x", "w"), at("y", "h")))
    # The first rows of a place are found on the map side before they are shuffled (a group limit).
    first = F.row_number().over(W.partitionBy("sample_id", "x", "y").orderBy("i"))
    seen = placed.withColumn("_first", first).where(F.col("_first") <= width).withColumn("e", F.explode(F.sequence(_epoch(F.col("i")), _epoch(F.col("last")))))
    both = seen.select("sample_id", "e", "code", "x", "y", "i", F.lit(False).alias("asks")).unionByName(placed.where("i > 0").select("sample_id", _epoch(F.col("i")).alias("e"), "code", "x", "y", "i", F.lit(True).alias("asks")))
    ranked = scan(both, ["sample_id", "e"], ["code", "x", "y", "i", "asks"], rank="at").withColumn("tile", F.floor(F.col("at") / tile))
    own = lambda c: F.when(~F.col("asks"), F.col(c))
    out = ranked.groupBy("sample_id", "e", "tile").agg(
        F.collect_list(F.struct("asks", "i", "x", "y")).alias("rows"), F.min(own("x")).alias("x0"), F.max(own("x")).alias("x1"), F.min(own("y")).alias("y0"), F.max(own("y")).alias("y1"), F.min(own("i")).alias("least")
    )
    inside = F.array_sort(F.transform(F.filter("rows", lambda r: ~r["asks"]), lambda r: r["i"]))
    return out.withColumn("enough", F.try_element_at(inside, F.lit(width)))


def _columns(rows: pa.Array, *names: str) -> list[np.ndarray]:
    flat = rows.flatten()
    return [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def _squares(qx: np.ndarray, qy: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dx, dy = qx[:, None] - x, qy[:, None] - y
    return dx * dx + dy * dy


def _bounds(ask: tuple[np.ndarray, ...], have: tuple[np.ndarray, ...], boxes: tuple[np.ndarray, ...], width: int) -> np.ndarray:
    """A squared distance for each asking row within which its nearest ones are."""
    qi, qx, qy = ask
    out = np.full(len(qi), np.inf)
    if len(have[0]) >= width:
        for a in range(0, len(qi), ASKS):
            own = slice(a, a + ASKS)
            d = _squares(qx[own], qy[own], have[1], have[2])
            d[have[0] >= qi[own, None]] = np.inf
            d.partition(width - 1, axis=1)
            out[own] = d[:, width - 1]
    _, x0, x1, y0, y1, _, enough = boxes
    far = np.flatnonzero(np.isinf(out))
    if len(far):
        # A box with enough earlier rows has them no farther off than its farthest corner.
        dx, dy = (np.maximum(np.abs(q[far, None] - lo), np.abs(q[far, None] - hi)) for q, lo, hi in ((qx, x0, x1), (qy, y0, y1)))
        corner = np.where(enough < qi[far, None], (dx * dx + dy * dy) * (1 + 1e-9), np.inf)
        out[far] = corner.min(1, initial=np.inf)
    return out


def _routes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """For each tile and each box that its asking rows may have neighbours in: those rows, with their bounds."""
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1)
            asks, i, x, y = _columns(row.column("rows"), "asks", "i", "x", "y")
            asks = asks.astype(bool)
            ask = qi, qx, qy = i[asks], x[asks], y[asks]
            if not len(qi):
                continue
            boxes = _columns(row.column("boxes"), "tile", "x0", "x1", "y0", "y1", "least", "enough")
            boxes[-1] = np.nan_to_num(boxes[-1].astype(np.float64), nan=np.inf)
            bound = _bounds(ask, (i[~asks], x[~asks], y[~asks]), boxes, width)
            number, x0, x1, y0, y1, least, _ = boxes
            dx, dy = (np.maximum(0.0, np.maximum(lo - q[:, None], q[:, None] - hi)) for q, lo, hi in ((qx, x0, x1), (qy, y0, y1)))
            # A margin keeps rounding on the safe side.
            near = ((dx * dx + dy * dy) * (1 - 1e-9) <= bound[:, None]) & (least < qi[:, None])
            to = np.flatnonzero(near.any(0))
            who = [np.flatnonzero(near[:, t]) for t in to]
            if len(to):
                flat, ends = np.concatenate(who), np.cumsum([0, *map(len, who)])
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v[flat])) for v in (qi, qx, qy, bound)]
                same = [pa.concat_arrays([row.column(c)] * len(to)) for c in ("sample_id", "e")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(number[to]), *lists], ["sample_id", "e", "tile", "qi", "qx", "qy", "bound"])


def _nearest(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(sample_id, i, j, d2): of each asking row, a tile's candidates within its bound, the nearest ``width`` at most."""
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1)
            asks, i, x, y = _columns(row.column("rows"), "asks", "i", "x", "y")
            mine = ~asks.astype(bool)
            j, x, y = i[mine], x[mine], y[mine]
            qi, qx, qy, bound = (row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("qi", "qx", "qy", "bound"))
            found = []
            for a in range(0, len(qi), ASKS):
                own = slice(a, a + ASKS)
                d = _squares(qx[own], qy[own], x, y)
                q, c = np.nonzero((d <= bound[own, None]) & (j < qi[own, None]))
                found.append((q + a, c, d[q, c]))
            q, c, d = (np.concatenate(f) for f in zip(*found, strict=True))
            order = np.lexsort((j[c], d, q))
            q, c, d = q[order], c[order], d[order]
            starts = np.searchsorted(q, np.arange(len(qi)))
            kept = np.arange(len(q)) - starts[q] < width
            q, c, d = q[kept], c[kept], d[kept]
            sample = pa.concat_arrays([row.column("sample_id")]).take(pa.array(np.zeros(len(q), np.int64)))
            yield pa.RecordBatch.from_arrays([sample, pa.array(qi[q]), pa.array(j[c]), pa.array(d)], ["sample_id", "i", "j", "d2"])


def causal_neighbours(spots: DataFrame, width: int = 6, tile: int = TILE) -> DataFrame:
    """The ``width`` nearest earlier rows (squared Euclidean, ties to the smaller row), with d2. Coordinates are finite.

    A row in 4**e .. 4**(e + 1) - 1 looks among the rows before 4**(e + 1), so early rows
    meet no more rows than late ones. The rows of a sample and epoch, ordered along a
    Morton curve, are cut into tiles of as many rows each: a crowded region is many small
    tiles, an empty one is part of a large one. What a row finds in its own tile
    bounds how far its neighbours can be (or the nearest box that has enough earlier rows
    does); it is then sent to the tiles whose boxes lie within that bound, and only to these.
    Of rows at one place only the first ``width`` can be neighbours of any. One plan
    serves all sizes; no task holds more than two tiles and the boxes of a sample.
    """
    if width < 1:
        return spots.select("sample_id", "i", F.lit(1).alias("r"), F.col("i").alias("j"), F.lit(0.0).alias("d2")).where(F.lit(False))
    tiles = materialise(_tiles(spots.withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double")), width, tile), "tiles")
    key = ["sample_id", "e", "block"]
    block = F.floor(F.col("tile") / SHARE)
    full = F.col("least").isNotNull()
    boxes = tiles.groupBy("sample_id", "e").agg(F.collect_list(F.when(full, F.struct("tile", "x0", "x1", "y0", "y1", "least", "enough"))).alias("boxes"), F.max(block).alias("last"))
    boxes = boxes.withColumn("boxes", F.when(F.size("boxes") > MOST_TILES, F.raise_error(F.lit("too many rows in one sample")).cast(boxes.schema["boxes"].dataType)).otherwise(F.col("boxes")))
    # Tiles are few bytes and much work, so they are dealt out by number and not by size.
    parts = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asking = tiles.select("sample_id", "e", block.alias("block"), "tile", "rows").repartition(parts, "sample_id", "e", "tile").drop("tile").join(boxes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))).drop("last"), key)
    kind = spots.schema["sample_id"].dataType.simpleString()
    routes = asking.mapInArrow(lambda it: _routes(it, width), f"sample_id {kind}, e int, tile bigint, qi array<bigint>, qx array<double>, qy array<double>, bound array<double>")
    met = routes.join(tiles.select("sample_id", "e", "tile", "rows"), ["sample_id", "e", "tile"]).select("sample_id", "qi", "qx", "qy", "bound", "rows")
    return _top(met.mapInArrow(lambda it: _nearest(it, width), f"sample_id {kind}, i bigint, j bigint, d2 double"), width).select("sample_id", "i", "r", "j", "d2")


def previous_rows(spots: DataFrame, width: int = 6) -> DataFrame:
    """The last ``width`` rows, in ascending order of j."""
    lo = F.greatest(F.lit(0), F.col("i") - width)
    return spots.where("i > 0").select("sample_id", "i", F.posexplode(F.sequence(lo, F.col("i") - 1)).alias("p", "j")).select("sample_id", "i", (F.col("p") + 1).alias("r"), "j")


def shuffled_coordinates(spots: DataFrame, seed: int) -> DataFrame:
    """Spots whose coordinates are permuted within their sample, as NumPy's generator of that seed permutes."""
    moved = permutation(spots, seed).select("sample_id", F.col("place").alias("i"), F.col("i").alias("source"))
    coords = spots.select("sample_id", F.col("i").alias("source"), "x", "y")
    return spots.drop("x", "y").join(moved, ["sample_id", "i"]).join(coords, ["sample_id", "source"]).drop("source")


def graph_faults(graph: DataFrame, spots: DataFrame, width: int = 6) -> DataFrame:
    """Rows that do not have exactly min(i, width) distinct earlier neighbours."""
    per = graph.groupBy("sample_id", "i").agg(F.count("*").alias("n"), F.countDistinct("j").alias("d"), F.max("j").alias("most"))
    all_ = spots.select("sample_id", "i").join(per, ["sample_id", "i"], "left")
    want = F.least(F.col("i"), F.lit(width))
    return all_.where((F.coalesce("n", F.lit(0)) != want) | (F.coalesce("d", F.lit(0)) != want) | (F.coalesce("most", F.lit(-1)) >= F.col("i")))


def edge_statistics(graph: DataFrame) -> DataFrame:
    """(sample_id, edges, mean, median and longest edge)."""
    edges = graph.select("sample_id", F.sqrt("d2").alias("d"))
    per = edges.groupBy("sample_id").agg(F.count("*").alias("edges"), F.round(F.avg("d"), 6).alias("mean_edge"), F.round(F.max("d"), 6).alias("longest_edge"))
    return per.join(quantiles(edges, ["sample_id"], "d", {"median_edge": 0.5}), "sample_id").select("sample_id", "edges", "mean_edge", F.round("median_edge", 6).alias("median_edge"), "longest_edge")


def neighbour_histogram(graph: DataFrame, spots: DataFrame) -> DataFrame:
    """(sample_id, neighbours, rows)."""
    per = graph.groupBy("sample_id", "i").agg(F.count("*").alias("k"))
    return spots.select("sample_id", "i").join(per, ["sample_id", "i"], "left").groupBy("sample_id", F.coalesce("k", F.lit(0)).alias("neighbours")).agg(F.count("*").alias("rows"))
