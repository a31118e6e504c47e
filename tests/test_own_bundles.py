"""Bundles of our own tables: tiles without zeros at their ends, places of cells, sizes beyond what is accepted from elsewhere."""

import json
from collections import Counter

import numpy as np
import pytest

from countloom.operators import layout
from countloom.plans import storage
from countloom.sources import reader
from tests.test_model import build
from tests.test_store import write_bundle


@pytest.mark.parametrize("records", [1, 3, 10_000])
def test_tiles_follow_positives(spark, records):
    """However cells are cut into batches, a tile is whole, begins and ends with a positive, and leaves out long runs of zeros."""
    dense = np.zeros((4, 40), np.int64)
    dense[0, [1, 2, 5, 15, 16, 30]], dense[1, [0, 39]], dense[3] = [1, 2, 3, 4, 5, 6], 7, np.arange(40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        m = build(spark, dense)
        got = {(r["i"], r["at"]): list(r["values"]) for r in layout.dense_tiles(m, 40, 16, 3).collect()}
        whole = {(r["i"], r["at"]): list(r["values"]) for r in layout.dense_tiles(m, 40, 16).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = {(0, 1): [1, 2, 0, 0, 3], (0, 15): [4], (0, 16): [5], (0, 30): [6], (1, 0): [7], (1, 39): [7]}
    assert got == rows | {(3, 1): list(range(1, 16)), (3, 16): list(range(16, 32)), (3, 32): list(range(32, 40))}
    assert whole == {(i, at): dense[i, at : at + 16].tolist() for i in range(4) for at in (0, 16, 32) if dense[i, at : at + 16].any()}


@pytest.mark.parametrize("by_row", [True, False])
def test_places_of_cells(spark, by_row):
    rng = np.random.default_rng(5)
    dense = rng.integers(0, 3, (9, 14)) * rng.integers(0, 2, (9, 14))
    dense[4] = 0
    pointers, entries = layout.compressed_parts(build(spark, dense), by_row)
    x, major, minor = (dense, "i", "g") if by_row else (dense.T, "g", "i")
    assert [r["ptr"] for r in pointers.orderBy(major).collect()] == [0, *np.cumsum((x > 0).sum(1)).tolist()]
    assert [(r["pos"], r[minor], r["v"]) for r in entries.orderBy("pos").collect()] == [(n, int(c), int(x[r, c])) for n, (r, c) in enumerate(zip(*np.nonzero(x), strict=True))]


def test_more_columns_than_are_accepted_from_elsewhere(spark, tmp_path):
    """Six GB of tables have 7.2 million parts; these were refused."""
    wide = reader.MAX_DIM + 1
    write_bundle(spark, tmp_path / "big", "csr_matrix", 9, shape=(3, wide), genes=lambda d: spark.range(wide).selectExpr("id as g", "'g' as gene_id"))
    assert [tuple(r) for r in reader.read_bundles(spark, f"file://{tmp_path}")[3].collect()] == [("big", "shape", 1)]
    cells, _, genes, faults = storage._read_own(spark, f"file://{tmp_path}")
    assert {tuple(r) for r in cells.collect()} == {("big", 0, 1, 2), ("big", 0, 3, 9), ("big", 1, 0, 3), ("big", 1, 2, 1)}
    assert faults.count() == 0 and genes.count() == wide


def test_values_out_of_range(spark, tmp_path):
    """Bad entries are faults in every encoding, counted as entries and as cells; other bundles are read."""
    for n, (encoding, at) in enumerate([(e, v) for e in reader.ENCODINGS for v in (-7, 5)]):
        write_bundle(spark, tmp_path / f"b{n}", encoding, at)
    cells, _, _, faults = reader.read_bundles(spark, f"file://{tmp_path}")
    assert Counter(map(tuple, faults.collect())) == Counter({("b0", "value", 1): 1, ("b2", "value", 1): 2, ("b4", "value", 1): 2})
    assert Counter(r["sample_id"] for r in cells.collect()) == {"b1": 4, "b3": 4, "b5": 4}


def test_tables_of_one_file(spark, tmp_path):
    """A table is a folder of files or one file; the bundle is the folder that holds it."""
    write_bundle(spark, tmp_path / "w" / "x", "csr_matrix", 9)
    (tmp_path / "f" / "y").mkdir(parents=True)
    for t in ("spots", "genes", "pointers", "entries"):
        (tmp_path / "f" / "y" / t).write_bytes(next((tmp_path / "w" / "x" / t).glob("*.parquet")).read_bytes())
    (tmp_path / "f" / "y" / "header.json").write_text(json.dumps({"encoding": "csr_matrix", "shape": [3, 4]}))
    for folder, name in (("w", "x"), ("f", "y")):
        cells, _, _, faults = reader.read_bundles(spark, f"file://{tmp_path}/{folder}")
        assert Counter(r["sample_id"] for r in cells.collect()) == {name: 4} and faults.count() == 0
