"""Runs of genes: a sample coded in parts, and work that follows positives."""

import numpy as np

from countloom.operators import coder
from countloom.sources import archive
from tests.test_model import DENSE, build


def test_runs_of_a_sample(spark, tmp_path):
    m = build(spark, DENSE["mixed"], np.random.default_rng(1).random((23, 2)))
    archive.encode_archives(m, 8, True, span=100).write.parquet(str(tmp_path / "a"))
    files = spark.read.parquet(str(tmp_path / "a"))
    assert files.count() > 3
    cells = archive.decode_archives(files)
    assert {(r["i"], r["g"]): r["v"] for r in cells.collect()} == {(i, g): DENSE["mixed"][i, g] for i, g in zip(*np.nonzero(DENSE["mixed"]), strict=True)}
    assert archive.verify(cells, archive.decode_axes(files), m).first()["all"]


def _model(n: int, genes: int, per: int, seed: int) -> tuple[coder.Model, coder.Found, np.ndarray]:
    """Genes of ``per`` positives a piece on average, the first of them all positive, on a random causal graph."""
    rng = np.random.default_rng(seed)
    graph = np.full((n, 6), -1)
    for i in range(n):
        graph[i, : min(i, 6)] = rng.permutation(i)[:6] if i < 50 else np.unique(rng.integers(0, i, 40))[:6]
    keys = np.unique(np.concatenate([np.arange(n) * genes, rng.integers(0, n * genes, genes * per)]))
    found = coder.Found(n, genes)
    found.add(np.arange(n), keys)
    q0 = np.clip(np.bincount(keys % genes, minlength=genes) * 4096 // n, 1, 4095)
    q = np.full(genes, 2048)
    tail = np.full((8, 8, 32), 128)
    odds = np.full((8, 7), 65536)
    return coder.Model(graph, q0, odds, q, np.zeros(genes, np.int64), odds, tail, coder.buckets_of(q0, coder.BUCKET_EDGES)), found, rng.integers(1, 9, len(keys))


def test_symbols_follow_positives(monkeypatch):
    """600 million cells, 60 thousand positives and genes each: cells are not coded one by one, yet cost what they would."""
    model, found, v = _model(10_000, 60_000, 1, 3)
    put, symbols = coder.LaneWriter.put, []
    monkeypatch.setattr(coder.LaneWriter, "put", lambda self, start, freq: (symbols.append(len(freq)), put(self, start, freq))[1])
    blob, cells, coded = model.encode_support(found, 64)
    assert sum(symbols) < 30 * (found.n + model.genes)
    assert cells * 0.99 < coded < cells * 1.02 and abs(8 * len(blob) - coded) < 5000
    got = model.decode_support(blob, found.n)
    back = model.decode_values(model.encode_values(found, v, 16)[0], got)
    at = got.of(np.arange(model.n))[1]
    assert (got.size == found.size).all() and (got.g[at] == found.g[: found.n]).all() and (back[at] == v).all()


def test_pieces_of_a_wave(monkeypatch):
    """However waves are cut, what is coded comes back."""
    for pairs in (1, 40, 1 << 20):
        monkeypatch.setattr(coder, "PAIRS", pairs)
        model, found, v = _model(120, 30, 20, 4)
        got = model.decode_support(model.encode_support(found, 3)[0], found.n)
        at = got.of(np.arange(model.n))[1]
        assert (got.size == found.size).all() and (got.g[at] == found.g[: found.n]).all()
        assert (model.decode_values(model.encode_values(found, v, 2)[0], got)[at] == v).all()
