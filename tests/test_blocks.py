"""Cells with their neighbours by blocks of genes, against brute force."""

import numpy as np
import pytest

from countloom.operators import blocks, graph, support
from tests.test_model import build


@pytest.mark.parametrize("block,pairs", [(1 << 20, 1 << 20), (20, 7)])
def test_blocks_and_pieces_give_the_same(spark, block, pairs):
    dense = np.random.default_rng(5).poisson(0.5, (25, 9)) * 3
    dense[:, 4] = 0
    m = build(spark, dense, np.random.default_rng(6).random((25, 2)))
    g = graph.causal_neighbours(m.spots, 8).cache()
    near = {(r["i"], r["r"]): r["j"] for r in g.collect()}
    of = lambda i, gene, w: [dense[near[i, k], gene] for k in range(1, w + 1) if (i, k) in near]
    cells, contexts = {}, {}
    for i, gene in np.ndindex(*dense.shape):
        k = {w: sum(x > 0 for x in of(i, gene, w)) for w in (2, 8)}
        if dense[i, gene] or k[8]:
            cells[i, gene] = (dense[i, gene] or None, *(x for w in (2, 8) for x in (k[w], sum(of(i, gene, w)))))
            for w in (2, 8):
                if i >= w:
                    n, y = contexts.get((w, gene, k[w]), (0, 0))
                    contexts[w, gene, k[w]] = n + 1, y + int(dense[i, gene] > 0)
    rows = lambda **more: {(r["i"], r["g"]): (r["v"], r["k2"], r["s2"], r["k8"], r["s8"]) for r in blocks.neighbour_cells(m, g, (2, 8), block=block, pairs=pairs, **more).collect()}
    assert rows() == cells
    assert rows(positive=True) == {at: x for at, x in cells.items() if x[0]}
    assert {(r["w"], r["g"], r["k"]): (r["n"], r["y"]) for r in blocks.context_counts(m, g, (2, 8), block=block, pairs=pairs).collect()} == contexts


def test_marginals_come_with_contexts(spark):
    """Contexts of whole genes count zero cells and absent genes too, and those of no neighbours are the marginals."""
    dense = np.random.default_rng(7).poisson(0.4, (30, 12))
    dense[:, [3, 11]] = 0
    m = build(spark, dense, np.random.default_rng(8).random((30, 2)))
    g = graph.causal_neighbours(m.spots, 6).cache()
    near = {(r["i"], r["r"]): r["j"] for r in g.collect()}
    want = {}
    for w, i, gene in ((w, i, gene) for w in (0, 6) for i, gene in np.ndindex(*dense.shape) if i >= w):
        k = sum(dense[near[i, r], gene] > 0 for r in range(1, w + 1))
        n, y = want.get((w, gene, k), (0, 0))
        want[w, gene, k] = n + 1, y + int(dense[i, gene] > 0)
    late = support.contexts_by_width(m, g, (0, 6)).cache()
    assert {(r["w"], r["g"], r["k"]): (r["n"], r["y"]) for r in late.collect()} == want
    marginals = support.gene_marginals(m).drop("b")
    assert sorted(support.marginals_of(late).select(marginals.columns).collect()) == sorted(marginals.collect())


def test_copies_of_the_graph_are_no_more_than_cells(spark):
    """Blocks grow with rows, so rows times blocks does not grow with the square of the input."""
    m = build(spark, np.random.default_rng(9).poisson(0.5, (40, 50)))
    held = m.counts.count() + 50
    (r,) = blocks.block_sizes(m, 10).collect()
    assert (r["n"], r["blocks"]) == (40, -(-held // 80))
    assert blocks.block_sizes(m, 1).first()["blocks"] * 40 * blocks.A_ROW < held + 80


def test_tiles_are_dealt_to_all_tasks(spark):
    """They are few bytes, so by size they would be one task."""
    m = build(spark, np.ones((5000, 1), np.int64), np.random.default_rng(10).random((5000, 2)))
    parts = graph.causal_neighbours(m.spots, 6, 64)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in parts
