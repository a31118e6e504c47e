"""Hash trees, folders of bundles, and work that is taken up again."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import hashtree, layout, resume
from countloom.sources import reader

CELL = "sample_id string, i bigint, g bigint, v bigint"


def cells(spark, seed, rows=700, samples=("a", "b")):
    rng = np.random.default_rng(seed)
    return [(s, i, int(g), int(rng.integers(1, 5))) for s in samples for i in range(rows) if i % 9 for g in rng.choice(40, 5, replace=False)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_tree_by_hand(spark):
    data = cells(spark, 1)
    got = {(r["sample_id"], r["level"], r["node"]): (r["cells"], r["sha256"]) for r in hashtree.tree(hashtree.leaves(spark.createDataFrame(data, CELL).repartition(5))).collect()}
    want = {}
    for s in ("a", "b"):
        level = {}
        for i in {c[1] for c in data if c[0] == s}:
            own = sorted((g, v) for t, j, g, v in data if (t, j) == (s, i))
            level[i] = len(own), sha(f"{i}|" + ",".join(f"{g}:{v}" for g, v in own))
        for n in range(1, hashtree.LEVELS + 1):
            up = {}
            for k in sorted(level):
                up.setdefault(k // hashtree.FAN, []).append(k)
            level = {p: (sum(level[k][0] for k in ks), sha(",".join(f"{k}={level[k][1]}" for k in ks))) for p, ks in up.items()}
            want |= {(s, n, k): v for k, v in level.items()}
    assert got == want


def trees(*matrices):
    return [hashtree.tree(hashtree.leaves(m)) for m in matrices]


def test_compare_against_all_cells(spark):
    data = cells(spark, 2, samples=("a", "b", "only a"))
    other = [(s, i, g, v + (i == 130)) for s, i, g, v in data if s != "only a" and not (s == "b" and i in (5, 6))] + [("b", 9999, 1, 1), ("new", 3, 3, 3)]
    a, b = (spark.createDataFrame(x, CELL) for x in (data, other))
    got = {r["sample_id"]: tuple(r)[1:6] for r in hashtree.compare(a, b, *trees(a, b)).collect()}
    assert got == {r["sample_id"]: tuple(r)[1:6] for r in layout.compare(a, b).collect()}
    few = {r["sample_id"]: (r["nodes"], r["differing"]) for r in hashtree.compare(a, b, *trees(a, b)).collect()}
    assert few["a"] == (11, 1) and few["b"] == (12, 3)


def test_equal_matrices_read_no_cell(spark):
    """Cells that fail when they are read: trees say that nothing differs."""
    a = spark.createDataFrame(cells(spark, 3), CELL)
    stored = trees(a, a)
    torn = a.repartition(3).withColumn("v", F.when(F.col("i") >= 0, F.raise_error(F.lit("read"))).cast("bigint"))
    got = hashtree.compare(torn, torn, *stored).collect()
    assert {(r["sample_id"], r["identical"], r["differing"]) for r in got} == {("a", True, 0), ("b", True, 0)} and all(r["equal"] == 622 * 5 for r in got)


def write_bundle(spark, path, encoding, at, shape=(3, 4), **change):
    """The matrix [[0, 2, 0, at], [3, 0, 1, 0], [0, 0, 0, 0]]."""
    change = {k: v for k, v in change.items()}
    tables = {"spots": spark.createDataFrame([(i, f"s{i}", float(i), 0.5) for i in range(3)], "i bigint, spot_id string, x double, y double"), "genes": spark.createDataFrame([(g, f"g{g}") for g in range(4)], "g bigint, gene_id string")}
    if encoding == "csr_matrix":
        tables |= {"pointers": spark.createDataFrame([(0, 0), (1, 2), (2, 4), (3, 4)], "pos bigint, ptr bigint"), "entries": spark.createDataFrame([(0, 1, 2), (1, 3, at), (2, 0, 3), (3, 2, 1)], "pos bigint, minor bigint, v bigint")}
    elif encoding == "csc_matrix":
        tables |= {"pointers": spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)], "pos bigint, ptr bigint"), "entries": spark.createDataFrame([(0, 1, 3), (1, 0, 2), (2, 1, 1), (3, 0, at)], "pos bigint, minor bigint, v bigint")}
    else:
        tables["dense"] = spark.createDataFrame([(0, [0, 2, 0, at]), (1, [3, 0, 1, 0]), (2, [0, 0, 0, 0])], "i bigint, values array<bigint>")
    for name, t in tables.items():
        change.get(name, lambda d: d)(t).coalesce(1).write.parquet(f"{path}/{name}")
    (path / "header.json").write_text(change.get("header", json.dumps({"encoding": encoding, "shape": shape})))


def test_folder_of_bundles(spark, tmp_path):
    """All encodings and faults in one folder: sound ones are read, the others are named."""
    kinds = ("csr_matrix", "csc_matrix", "dense_array")
    for n in range(6):
        write_bundle(spark, tmp_path / f"good{n}", kinds[n % 3], 7 + n)
    write_bundle(spark, tmp_path / "pointers", "csr_matrix", 7, pointers=lambda d: d.where("pos < 3"))
    write_bundle(spark, tmp_path / "falls", "csc_matrix", 7, pointers=lambda d: d.selectExpr("pos", "if(pos = 1, 3, ptr) ptr"))
    write_bundle(spark, tmp_path / "wide", "dense_array", 7, shape=(3, 3), genes=lambda d: d.where("g < 3"))
    write_bundle(spark, tmp_path / "negative", "dense_array", -7)
    write_bundle(spark, tmp_path / "label", "csr_matrix", 7, genes=lambda d: d.selectExpr("g", "if(g = 1, null, gene_id) gene_id"))
    write_bundle(spark, tmp_path / "other", "coo", 7)
    write_bundle(spark, tmp_path / "torn", "csr_matrix", 7, header='{"encoding": "csr_ma')
    counts, spots, genes, faults = reader.read_bundles(spark, f"file://{tmp_path}")
    want = Counter((f"good{n}", *c) for n in range(6) for c in ((0, 1, 2), (0, 3, 7 + n), (1, 0, 3), (1, 2, 1)))
    assert Counter(map(tuple, counts.collect())) == want
    assert Counter(r["sample_id"] for r in spots.collect()) == {f"good{n}": 3 for n in range(6)} and genes.count() == 24
    assert {(r["sample_id"], r["fault"]) for r in faults.collect()} >= {("pointers", "pointer_count"), ("falls", "falling_pointer"), ("wide", "shape"), ("negative", "value"), ("label", "gene_label"), ("other", "encoding"), ("torn", "encoding")}
    assert not [r for r in faults.collect() if r["sample_id"].startswith("good")]


@pytest.mark.parametrize("encoding", ["csr_matrix", "dense_array"])
def test_folder_of_one_encoding(spark, tmp_path, encoding):
    write_bundle(spark, tmp_path / "x", encoding, 9)
    counts, _, _, faults = reader.read_bundles(spark, f"file://{tmp_path}")
    assert {tuple(r) for r in counts.collect()} == {("x", 0, 1, 2), ("x", 0, 3, 9), ("x", 1, 0, 3), ("x", 1, 2, 1)} and faults.count() == 0


def test_number_of_plans_does_not_follow_bundles(spark, tmp_path):
    """Twelve bundles take as many jobs to plan as two."""
    used = []
    for folder, n in (("few", 2), ("many", 12)):
        for k in range(n):
            write_bundle(spark, tmp_path / folder / f"b{k}", ("csr_matrix", "dense_array")[k % 2], 3)
        spark.sparkContext.setJobGroup(folder, folder)
        reader.read_bundles(spark, f"file://{tmp_path}/{folder}")[0].count()
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(folder)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert used[1] <= used[0] + 1


def plan_of(spark, n=40):
    return spark.createDataFrame([(f"s{k % 8}", k) for k in range(n)] + [("s0", 0)], "s string, k bigint")


def work(due):
    """Every third key fails at first, every tenth always."""
    failed = (F.col("k") % 10 == 0) | (F.col("attempt") == 1) & (F.col("k") % 3 == 0)
    return due.withColumn("status", F.when(failed, "failed").otherwise("success")).withColumn("out", F.when(~failed, F.col("k") * 2))


def test_all_rounds(spark, tmp_path):
    plan, folder = plan_of(spark), f"file://{tmp_path}/w"
    ledger = {(r["k"], r["attempt"]): r["status"] for r in resume.run_all(plan, ["s", "k"], work, folder, 3).collect()}
    for k in range(40):
        tried = [ledger.get((k, a)) for a in (1, 2, 3)]
        assert tried == (["failed"] * 3 if k % 10 == 0 else ["failed", "success", None] if k % 3 == 0 else ["success", None, None])
    assert {r["k"]: r["out"] for r in resume.results(spark, folder, ["s", "k"]).collect()} == {k: 2 * k for k in range(40) if k % 10}
    assert resume.run_once(plan, ["s", "k"], work, folder, 3) == 0


@pytest.mark.parametrize("when", ["in work", "before the ledger"])
def test_killed_round(spark, tmp_path, monkeypatch, when):
    """A round that ends early leaves nothing that counts; the next does its keys once."""
    plan, folder, keys = plan_of(spark), f"file://{tmp_path}/w", ["s", "k"]
    resume.run_once(plan.where("k < 15"), keys, work, folder, 3)
    with monkeypatch.context() as m:
        if when == "in work":
            broken = lambda due: work(due).withColumn("out", F.when(F.col("k") == 33, F.raise_error(F.lit("killed")).cast("bigint")).otherwise(F.col("out")))
        else:
            broken = work
            from pyspark.sql.readwriter import DataFrameWriter

            real = DataFrameWriter.parquet

            def parquet(self, path, *a, **k):
                if path.endswith("/ledger"):
                    raise RuntimeError("killed")
                return real(self, path, *a, **k)

            m.setattr(DataFrameWriter, "parquet", parquet)
        with pytest.raises(Exception, match="killed"):
            resume.run_once(plan, keys, broken, folder, 3)
    seen = {r["k"] for r in resume.results(spark, folder, keys).collect()}
    assert seen == {k for k in range(15) if k % 10 and k % 3}
    resume.run_all(plan, keys, work, folder, 3)
    assert Counter((r["k"], r["out"]) for r in resume.results(spark, folder, keys).collect()) == Counter((k, 2 * k) for k in range(40) if k % 10)
