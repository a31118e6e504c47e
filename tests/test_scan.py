"""Segmented scans, joins by frequency and scoped tables against plain Python."""

import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from countloom.operators.scan import ranges, scan
from countloom.operators.skew import join_by_frequency
from countloom.sources import matrix, shared
from countloom.sources.shared import materialise, scoped_tables, shared_dir


_fresh: list[str] = []


@pytest.fixture(autouse=True)
def note_paths(monkeypatch):
    real = shared.fresh_path

    def fresh(spark, tag):
        _fresh.append(real(spark, tag))
        return _fresh[-1]

    monkeypatch.setattr(shared, "fresh_path", fresh)


@pytest.fixture(params=[4, 211])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def expected(rows):
    out, seen = [], {}
    for s, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n, total, before = seen.get(s, (0, None, None))
        upto = total if v is None else v + (total or 0)
        out.append((s, k, v, n, upto, before))
        seen[s] = n + 1, upto, v
    return Counter((*r, seen[r[0]][0]) for r in out)


def test_scan(spark, partitions):
    """A segment of most rows, small ones, one row, a null segment; null values before, between and after."""
    rows = [("hot", k, None if k < 40 or k % 5 == 0 else k) for k in range(3000)] + [(f"s{k % 50}", k, k) for k in range(300)] + [("one", 7, None), (None, 1, 5), (None, 2, 6)]
    df = spark.createDataFrame(rows, "s string, k bigint, v bigint").repartition(7)
    got = scan(df, ["s"], ["k"], rank="r", sums={"t": "v"}, lags={"b": "v"}, size="n")
    assert got.columns == ["s", "k", "v", "r", "t", "b", "n"]
    assert Counter(tuple(r) for r in got.collect()) == expected(rows)
    assert scan(df.where("false"), ["s"], ["k"], rank="r", sums={"t": "v"}, lags={"b": "v"}, size="n").count() == 0


def test_large_segment_is_spread(spark, partitions):
    df = spark.range(1_000_000).select(F.lit("a").alias("s"), (F.col("id") * 7919 % 1_000_003).alias("k"))
    sizes = [r["count"] for r in ranges(df, ["s"], ["k"]).groupBy("_part").count().collect()]
    assert len(sizes) > partitions * 0.9 and max(sizes) < 3 * 1_000_000 / partitions
    got = scan(df, ["s"], ["k"], rank="r", sums={"t": "k"}).agg(F.sum("r").alias("r"), F.max("r").alias("m"), F.max("t").alias("t"), F.sum("k").alias("k"), F.countDistinct("r").alias("d")).first()
    assert (got["r"], got["m"], got["d"]) == (999_999 * 500_000, 999_999, 1_000_000) and got["t"] == got["k"]


def test_pointers(spark, partitions):
    counts = spark.createDataFrame([("a", i, g, 1 + g) for i in range(500) for g in range(i % 4)] + [("b", 2, 0, 9)], "sample_id string, i bigint, g bigint, v bigint")
    rows = spark.createDataFrame([("a", i) for i in range(500)] + [("b", i) for i in range(4)], "sample_id string, i bigint")
    got = {(r["sample_id"], r["i"]): (r["ptr_lo"], r["ptr_hi"], r["minors"], r["vals"]) for r in matrix.to_compressed(counts, rows).collect()}
    at = 0
    for i in range(500):
        assert got["a", i] == (at, at + i % 4, list(range(i % 4)), [1 + g for g in range(i % 4)])
        at += i % 4
    assert [got["b", i] for i in range(4)] == [(0, 0, [], []), (0, 0, [], []), (0, 1, [0], [9]), (1, 1, [], [])]
    broken = spark.createDataFrame([("a", i, i if i != 300 else 5) for i in range(400)] + [("b", 0, 3), ("b", 1, 3)], "sample_id string, i bigint, ptr bigint")
    assert {(r["sample_id"], r["i"], r["before"]) for r in matrix.pointer_faults(broken).collect()} == {("a", 300, 299), ("b", 0, None)}


def test_join_by_frequency(spark):
    rows = spark.createDataFrame([(("hot" if i % 3 else f"k{i}"), i) for i in range(900)] + [("absent", 1), (None, 2)], "k string, i bigint")
    keys = rows.where("k <> 'absent'").groupBy("k").agg(F.count("*").alias("n"))
    want = sorted((r["k"], r["i"], r["n"]) for r in rows.join(keys, "k").collect())
    for share in (0.0, 0.01, 1.0):
        assert sorted((r["k"], r["i"], r["n"]) for r in join_by_frequency(rows, keys, "k", "n", share).collect()) == want
    assert join_by_frequency(rows, keys.where("false"), "k", "n").count() == 0


def own_tables(spark):
    """Names in the shared folder that this process wrote; another one may use the folder as well."""
    folder = shared_dir(spark).removeprefix("file://")
    return {p.rsplit("/", 1)[1] for p in _fresh} & set(os.listdir(folder))


def test_scoped_tables(spark):
    kept = materialise(spark.range(3), "kept")
    before = own_tables(spark)
    with pytest.raises(ZeroDivisionError), scoped_tables(spark):
        materialise(spark.range(5), "gone")
        assert own_tables(spark) > before
        raise ZeroDivisionError
    assert own_tables(spark) == before and kept.count() == 3


def test_queries_side_by_side(spark, small):
    """What one drops is never another's."""
    from countloom.plans.queries import QUERIES
    from countloom.sources.shared import together

    names = ("w4_row_pointers", "a1_gene_marginals", "w7_canonical_order")
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, small).collect()))
    assert together(*[lambda n=n: rows(n) for n in names * 2]) == [rows(n) for n in names * 2]


@pytest.mark.parametrize("name, most", [("m10_code_length_k32", 12), ("a8_sufficient_statistics", 4), ("w4_row_pointers", 3), ("canonical_counts", 1)])
def test_queries_leave_what_their_results_read(spark, small, name, most):
    from countloom.plans.queries import QUERIES

    before = own_tables(spark)
    got = QUERIES[name](spark, small)
    left = own_tables(spark) - before
    read = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert left <= read and len(left) <= most and got.count() > 0


@pytest.mark.parametrize("given, known", [("/ck", "viewfs://cluster/ck"), ("file:{tmp}/", "file://{tmp}"), ("file://{tmp}", "file://{tmp}")])
def test_folder_is_named_with_its_file_system(tmp_path, given, known):
    """A checkpoint folder without a scheme is where Spark writes it, not where the machine would."""
    given, known = (x.replace("{tmp}", str(tmp_path)) for x in (given, known))
    code = f"""
from pyspark.sql import SparkSession
from countloom.sources.shared import fresh_path, materialise, shared_dir
b = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{given}")
b = b.config("spark.hadoop.fs.defaultFS", "viewfs://cluster/").config("spark.hadoop.fs.viewfs.mounttable.cluster.link./ck", "file://{tmp_path}")
s = b.getOrCreate()
assert shared_dir(s) == "{known}", shared_dir(s)
assert materialise(s.range(4), "t").count() == 4
import os
assert any(n.startswith("t-") for n in os.listdir("{tmp_path}"))
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=repo, timeout=180).returncode == 0
