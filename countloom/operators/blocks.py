"""Cells with their neighbours, by blocks of genes.

What a cell's neighbours hold of its gene has nothing to do with other genes. So the
positive cells of a sample are dealt into blocks of genes, each block meets the sample's
graph, and all of a gene's cells are looked at by one task: positives are shuffled once, not
once a neighbour, and a gene's contexts are counted where they are found. A block
holds about ``BLOCK`` positives, or ``A_ROW`` for each of the sample's rows where that is more: so the graph's
copies are no more than the positives, however many rows there are. A task looks at about ``PAIRS``
positives and neighbours' positives at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.matrix import CountMatrix, few

BLOCK, A_ROW, PAIRS = 1_000_000, 2, 2_000_000
#: Rows whose edges travel as one record.
CHUNK = 65_536


def _flat(edges: pa.Table, name: str) -> np.ndarray:
    return np.asarray(edges.column(name).combine_chunks().flatten(), np.int64) if edges.num_rows else np.empty(0, np.int64)


def _edges(edges: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, neighbour) of the first ``width`` places, by row."""
    i, r, j = (_flat(edges, c) for c in ("i", "r", "j"))
    own = np.flatnonzero(r <= width)
    own = own[np.argsort(i[own], kind="stable")]
    return i[own], r[own], j[own]


def _pieces(cells: pa.Table, edges: pa.Table, widths: tuple[int, ...], pairs: int, valued: bool = True) -> tuple[np.ndarray, Iterator[tuple]]:
    """(genes, pieces of (row, place of the gene, positive, value, k by width, s by width)) of a block's cells that are positive or have a positive neighbour.

    valued: with values and their sums, else None for both. Genes may come without a row, so without cells.
    """
    i, v, g = (np.asarray(cells.column(c), np.int64) for c in ("i", "v", "g"))
    genes, own = np.unique(g, return_inverse=True)
    order = np.argsort(i, kind="stable")
    order = order[np.searchsorted(i[order], 0) :]
    i, v, own = i[order], v[order], own[order]
    ei, er, ej = _edges(edges, max(widths))
    rows = int(max(i.max(initial=-1), ei.max(initial=-1), ej.max(initial=-1))) + 1
    ptr = np.searchsorted(i, np.arange(rows + 1))
    size = ptr[ej + 1] - ptr[ej]
    # A cell and a place of its neighbourhood are one number, so sorting needs no second array.
    low, high = int(max(widths)).bit_length(), len(genes).bit_length()

    def run() -> Iterator[tuple]:
        load = np.cumsum(np.bincount(ei, size, rows) + np.diff(ptr)) // pairs
        cuts = [0, *(np.flatnonzero(np.diff(load)) + 1), rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            (lo, hi), (p, q) = np.searchsorted(ei, (a, b)), ptr[[a, b]]
            n = size[lo:hi]
            at = np.repeat(ptr[ej[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            key = np.concatenate([np.repeat(((ei[lo:hi] - a) << (high + low)) + er[lo:hi], n) + (own[at] << low), ((i[p:q] - a) << (high + low)) + (own[p:q] << low)])
            if not len(key):
                continue
            value = None
            if valued:
                by = np.argsort(key)
                key, value = key[by], np.concatenate([v[at], v[p:q]])[by]
            else:
                key.sort()
            place, cell = key & ((1 << low) - 1), key >> low
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            count = np.diff(first, append=len(cell))
            cell, mine = cell[first], place[first] == 0
            sums = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
            inside = {w: (place > 0) & (place <= w) for w in widths if w and (valued or w < max(widths))}
            k = [np.zeros(len(cell), np.int64) if not w else count - mine if w == max(widths) else sums(inside[w].astype(np.int64)) for w in widths]
            own_value, s = (np.where(mine, value[first], 0), [sums(np.where(inside[w], value, 0)) if w else np.zeros(len(cell), np.int64) for w in widths]) if valued else (None, None)
            yield a + (cell >> high), cell & ((1 << high) - 1), mine, own_value, k, s

    return genes, run()


def block_sizes(m: CountMatrix, block: int = BLOCK) -> DataFrame:
    """(sample_id, n, blocks) of every sample: its rows, and into how many blocks its genes are dealt."""
    rows = m.spots.groupBy("sample_id").agg(F.count("*").alias("n"))
    cells = m.counts.groupBy("sample_id").agg(F.count("*").alias("cells"))
    genes = m.genes.agg(F.count("*").alias("genes"))
    held = F.coalesce("cells", F.lit(0)) + F.col("genes")
    return rows.join(cells, "sample_id", "left").join(F.broadcast(genes)).select("sample_id", "n", F.greatest(F.lit(1), F.ceil(held / F.greatest(F.lit(block), F.lit(A_ROW) * F.col("n")))).cast("int").alias("blocks"))


def _by_block(m: CountMatrix, graph: DataFrame, widths: tuple[int, ...], look: Callable[[pa.Table, pa.Table], dict[str, np.ndarray]], schema: str, block: int, whole: bool = False) -> DataFrame:
    """look(cells, edges) of every sample and block, as rows of ``schema`` behind their sample_id. whole: genes come as cells without a row as well, so that none is missing."""
    sizes = few(block_sizes(m, block))
    cells = m.counts.select("sample_id", "i", "g", "v")
    if whole:
        none = F.lit(-1).cast("bigint")
        cells = cells.unionByName(m.genes.select("g").join(few(m.spots.select("sample_id").distinct())).select("sample_id", none.alias("i"), "g", none.alias("v")))
    cells = cells.join(sizes, "sample_id").select("sample_id", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int").alias("block"), F.col("i").cast("int").alias("i"), F.col("g").cast("int").alias("g"), "v")
    # Numbers travel in arrays of their own, without what a struct for each edge would take.
    kinds = {"i": "int", "r": "smallint", "j": "int"}
    edge = F.struct(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    packed = graph.where(F.col("r") <= max(widths)).groupBy("sample_id", F.floor(F.col("i") / CHUNK).alias("_at")).agg(F.array_sort(F.collect_list(edge)).alias("e"))
    packed = packed.select("sample_id", *[F.col(f"e.{c}").alias(c) for c in kinds])
    lengths = m.spots.select("sample_id").distinct().select("sample_id", *[F.array().cast(f"array<{t}>").alias(c) for c, t in kinds.items()])
    edges = packed.unionByName(lengths).join(sizes, "sample_id").select("sample_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "n", *kinds)
    kind = m.counts.schema["sample_id"].dataType.simpleString()

    def run(key: tuple, own: pa.Table, near: pa.Table) -> pa.Table:
        # Genes are dealt by hash, so a block may be without any.
        if not own.num_rows:
            return empty
        out = look(own, near)
        n = len(next(iter(out.values())))
        return pa.table({"sample_id": pa.repeat(key[0], n), **out})

    out_schema = f"sample_id {kind}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(out_schema)).empty_table()
    by = ("sample_id", "block")
    return cells.groupBy(*by).cogroup(edges.groupBy(*by)).applyInArrow(run, out_schema)


def neighbour_cells(m: CountMatrix, graph: DataFrame, widths: tuple[int, ...] = (6,), positive: bool = False, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """(sample_id, i, g, v, k<w> and s<w> for each width w) of all cells that are positive or have a positive neighbour; positive: of positive ones only.

    k counts a cell's positive neighbours among the first w, s sums them; v is null
    where the cell itself is zero.
    """

    def look(cells: pa.Table, edges: pa.Table) -> dict[str, np.ndarray]:
        genes, pieces = _pieces(cells, edges, widths, pairs)
        parts = []
        for i, g, mine, v, k, s in pieces:
            kept = np.flatnonzero(mine) if positive else slice(None)
            parts.append([x[kept] for x in (i, genes[g], v, mine, *(c for both in zip(k, s, strict=True) for c in both))])
        i, g, v, mine, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"i": i, "g": g, "v": pa.array(v, mask=~mine), **dict(zip(names, sums, strict=True))}

    names = [f"{c}{w}" for w in widths for c in ("k", "s")]
    return _by_block(m, graph, widths, look, ", ".join(f"{c} bigint" for c in ("i", "g", "v", *names)), block)


def context_counts(m: CountMatrix, graph: DataFrame, widths: tuple[int, ...] = (6,), block: int = BLOCK, pairs: int = PAIRS, whole: bool = False) -> DataFrame:
    """(sample_id, w, g, k, n, y): of the cells that ``neighbour_cells`` finds past the first w rows, how many there are and how many are positive, by gene and positive neighbours among w.

    whole: of all cells past the first w rows, of all genes: those not found have no positive neighbours and are zero.
    """

    def look(cells: pa.Table, edges: pa.Table) -> dict[str, np.ndarray]:
        genes, pieces = _pieces(cells, edges, widths, pairs, valued=False)
        seen = [np.zeros((2, len(genes) * (w + 1)), np.int64) for w in widths]
        for i, g, mine, _, k, _ in pieces:
            for w, own, near in zip(widths, seen, k, strict=True):
                late = i >= w
                at = (g * (w + 1) + near)[late]
                own[0] += np.bincount(at, minlength=own.shape[1])
                own[1] += np.bincount(at[mine[late]], minlength=own.shape[1])
        out = []
        for w, (n, y) in zip(widths, seen, strict=True):
            if whole:
                by_gene = n.reshape(len(genes), w + 1)
                by_gene[:, 0] += max(edges.column("n")[0].as_py() - w, 0) - by_gene.sum(1)
            at = np.flatnonzero(n)
            out.append((np.full(len(at), w), genes[at // (w + 1)], at % (w + 1), n[at], y[at]))
        return dict(zip(("w", "g", "k", "n", "y"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True))

    return _by_block(m, graph, widths, look, "w bigint, g bigint, k bigint, n bigint, y bigint", block, whole)
