"""Tables, blobs and streams."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.functions import numbers
from countloom.operators import graph, sharing
from countloom.operators.quantiles import quantiles
from countloom.sources import matrix, reader, shared, tables
from countloom.streaming import coverage


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfid,n\nx,1\ny,\n")
    rows = tables.read_csv(spark, str(tmp_path / "a.csv"), "id string, n int").collect()
    assert [(r["id"], r["n"]) for r in rows] == [("x", 1), ("y", None)]
    tables.write_csv(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        tables.write_csv(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "out"))


def test_torn_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 2}\n\n{"k": "a", "v": 3}\n{"k": "c", "v"')
    good, bad, twice = tables.read_jsonl(spark, str(tmp_path / "r.jsonl"), T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())]), ["k"])
    assert good.count() == 3 and bad.count() == 1 and [(r["k"], r["n"]) for r in twice.collect()] == [("a", 2)]


def test_exclusive_sink(spark, tmp_path):
    df = spark.range(3)
    tables.write_exclusive(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="exist"):
        tables.write_exclusive(df, str(tmp_path / "p"))


@pytest.mark.parametrize("parts", ["4", "211"])
def test_ordinals_of_many_keys(spark, parts):
    """Positions are 0 to n - 1 in key order, alike in every evaluation and on every partitioning."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        keys = spark.range(50_000).select((F.col("id") * 7919 % 1_000_003).alias("key"))
        got = matrix.ordinals(keys, "key", "n")
        first, again = ({r["key"]: r["n"] for r in got.collect()} for _ in range(2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == again and [first[k] for k in sorted(first)] == list(range(50_000))
    assert matrix.ordinals(keys.limit(0), "key", "n").count() == 0


def test_shared_folder(spark, tmp_path):
    own = shared.shared_dir(spark)
    df = shared.materialise(spark.range(5), "x")
    assert own == shared.shared_dir(spark) and df.count() == 5 and df.inputFiles()[0].removeprefix("file://").startswith(own.removeprefix("file://"))
    shared.discard(df, None, spark.range(1))
    with pytest.raises(Exception, match="(?i)not.*exist|not_found"):
        spark.read.parquet(df._countloom_path).count()

    class Unset:
        class conf:
            get = staticmethod(lambda key, other=None: other)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app-unset"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Unset)
    Unset.sparkContext.master = "local[2]"
    assert shared.shared_dir(Unset) == shared.shared_dir(Unset) != own


DENSE = np.array([[0, 2, 0, 9], [3, 0, 1, 0], [0, 0, 0, 0]])


def bundle(spark, path, encoding, shape=(3, 4), change=None):
    import json
    import os

    parts = {
        "spots": spark.createDataFrame([(i, f"s{i}", float(i), 0.5) for i in range(3)], "i bigint, spot_id string, x double, y double"),
        "genes": spark.createDataFrame([(g, "same") for g in range(4)], "g bigint, gene_id string"),
    }
    if encoding == "dense_array":
        parts["dense"] = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(DENSE)], "i bigint, values array<bigint>")
    else:
        a = DENSE if encoding == "csr_matrix" else DENSE.T
        major, minor = np.nonzero(a)
        parts["pointers"] = spark.createDataFrame([(i, int(p)) for i, p in enumerate(np.searchsorted(major, np.arange(len(a) + 1)))], "pos bigint, ptr bigint")
        parts["entries"] = spark.createDataFrame([(p, int(m), float(a[i, m])) for p, (i, m) in enumerate(zip(major, minor, strict=True))], "pos bigint, minor bigint, v double")
    parts |= {k: f(parts[k]) for k, f in (change or {}).items()}
    os.makedirs(path)
    (path / "header.json").write_text(json.dumps({"encoding": encoding, "shape": shape}))
    for name, df in parts.items():
        df.write.parquet(str(path / name))
    return str(path)


@pytest.mark.parametrize("encoding", reader.ENCODINGS)
def test_bundles_of_all_encodings(spark, tmp_path, encoding):
    m = reader.read_bundle(spark, bundle(spark, tmp_path / "b", encoding), "s")
    assert {(r["i"], r["g"]): r["v"] for r in m.counts.collect()} == {(0, 1): 2, (0, 3): 9, (1, 0): 3, (1, 2): 1}
    assert m.spots.count() == 3 and m.genes.count() == 4


BROKEN = {
    "shape": ("csr_matrix", {"shape": (0, 4)}), "pointer_count": ("csr_matrix", {"change": {"pointers": lambda d: d.where("pos < 3")}}), "first_pointer": ("csr_matrix", {"change": {"pointers": lambda d: d.selectExpr("pos", "if(pos = 0, 1, ptr) ptr")}}),
    "last_pointer": ("csc_matrix", {"change": {"pointers": lambda d: d.selectExpr("pos", "if(pos = 4, 9, ptr) ptr")}}), "falling_pointer": ("csc_matrix", {"change": {"pointers": lambda d: d.selectExpr("pos", "if(pos = 1, 3, ptr) ptr")}}),
    "minor_range": ("csr_matrix", {"change": {"entries": lambda d: d.selectExpr("pos", "minor + 2 minor", "v")}}), "value": ("csr_matrix", {"change": {"entries": lambda d: d.selectExpr("pos", "minor", "v + 0.5 v")}}),
    "spot_count": ("dense_array", {"change": {"spots": lambda d: d.where("i > 0")}}), "gene_label": ("dense_array", {"change": {"genes": lambda d: d.selectExpr("g", "if(g = 1, null, gene_id) gene_id")}}),
    "coordinates": ("dense_array", {"change": {"spots": lambda d: d.selectExpr("i", "spot_id", "x", "double('nan') y")}}), "unknown encoding": ("other", {}), "not a bundle": ("dense_array", {"change": {"dense": lambda d: d.selectExpr("i")}}),
}


@pytest.mark.parametrize("fault", BROKEN)
def test_broken_bundles_are_refused(spark, tmp_path, fault):
    encoding, more = BROKEN[fault]
    with pytest.raises(ValueError, match=fault):
        reader.read_bundle(spark, bundle(spark, tmp_path / "b", encoding, **more)).counts.collect()


def test_cells_that_a_decoder_must_not_repair(spark):
    cells = spark.createDataFrame([("s", 0, 0, 1), ("s", 0, 0, 2), ("s", 1, 0, 0), ("t", 0, 0, 4)], "sample_id string, i bigint, g bigint, v bigint")
    assert sorted(map(tuple, reader.noncanonical(cells).collect())) == [("s", "repeated", 1), ("s", "zero", 1)]


def test_packed_integers(spark):
    from countloom.functions import numbers

    rng = np.random.default_rng(8)
    rows = [(n, rng.integers(0, 4096, n).tolist()) for n in (0, 1, 2, 3, 10, 33)]
    df = spark.createDataFrame(rows, "n int, v array<bigint>").select("n", "v", numbers.pack12(F.col("v")).alias("hex")).withColumn("back", numbers.unpack12(F.col("hex"), F.size("v")))
    for r in df.collect():
        assert bytes.fromhex(r["hex"]) == sharing.pack12(np.array(r["v"], np.int64)) and r["back"] == r["v"]


def _plain(values):
    """What a plain sum says of infinities and NaNs, math.fsum of the rest, None without any."""
    some = [v for v in values if v is not None]
    odd = [v for v in some if not math.isfinite(v)]
    if odd:
        return sum(odd)
    if not some:
        return None
    try:
        return math.fsum(some)
    except OverflowError:
        return math.inf if sum(map(Fraction, some)) > 0 else -math.inf


def test_exact_sum(spark):
    """Cancellation, subnormals, the largest doubles, ties of rounding, signs, nulls, infinities: equal to the last bit, however rows are dealt."""
    rng = np.random.default_rng(17)
    inf, nan = math.inf, math.nan
    groups = {
        "cancel": [1e16, 1.0, -1e16, 1e-9, 3e300, -3e300] * 50 + [1e-300], "small": [5e-324, 2.2e-308, -1e-310, 2.0**-1022, 2.0**-960, 2.0**-961] * 3, "large": [1.7976931348623157e308, -1.7976931348623157e308, 1e292],
        "beyond": [1.7976931348623157e308] * 3, "below": [-1.7976931348623157e308] * 3, "tie": [1.0, 2.0**-53], "over tie": [1.0, 2.0**-53, 2.0**-200], "powers": [2.0**k for k in range(-1074, 1023, 7)], "near": [np.nextafter(2.0**k, 0) for k in range(-1000, 1000, 37)],
        "zero": [0.0, -0.0], "null": [None, None], "some": [None, 0.1, 0.2, None, 0.3], "inf": [inf, 1.0], "both": [inf, -inf], "nan": [nan, 1.0], "one": [-0.1],
        "bits": rng.integers(0, 2**63, 600).view(np.float64)[np.isfinite(rng.integers(0, 2**63, 600).view(np.float64))].tolist(), "many": (rng.normal(size=20_000) * 10.0 ** rng.integers(-20, 20, 20_000)).tolist(),
    }
    groups["bits"] = [v for v in groups["bits"] if math.isfinite(v)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    same = lambda a, b: a is b is None or a is not None and b is not None and (a == b or a != a and b != b)
    for parts in (1, 7):
        got = {r["g"]: r["s"] for r in numbers.exact_sum(df.repartition(parts), ["g"], F.col("v"), "s").collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert same(got[g], _plain(vs)), (g, got[g], _plain(vs))
    plan = numbers.exact_sum(df, ["g"], F.col("v"), "s")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and numbers.exact_sum(df.where("false"), ["g"], F.col("v"), "s").count() == 0


def test_quantiles(spark):
    """Against NumPy: ties, a value that most rows share, one row, nulls, a null group."""
    rng = np.random.default_rng(23)
    groups = {"spread": rng.normal(size=3001).tolist(), "ties": rng.integers(0, 4, 1000).astype(float).tolist(), "hot": [0.0] * 2000 + rng.random(10).tolist(), "one": [4.5], "two": [1.0, 2.0], "signs": [-0.0, 0.0, -3.0], "none": [None], None: [1.0, 5.0, None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    ps = {"lo": 0.0, "q": 0.25, "m": 0.5, "t": 0.9, "hi": 1.0}
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", ps).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, r in got.items():
        for name, p in ps.items():
            assert r[name] == pytest.approx(np.quantile([v for v in groups[g] if v is not None], p), abs=1e-12)
    assert quantiles(df.where("false"), ["g"], "v", ps).count() == 0


@pytest.mark.parametrize("genes", [1, 7, 8, 9, 100])
def test_shared_rates(genes):
    rng = np.random.default_rng(genes)
    groups, own, centres = rng.integers(0, 8, genes), rng.integers(1, 4096, genes), rng.integers(1, 4096, 8)
    assert (sharing.decode(sharing.encode(centres, groups, own), groups) == centres[groups]).all()
    for share in (0.0, 0.5, 1.0):
        mask = rng.random(genes) < share
        blob = sharing.encode(centres, groups, own, mask)
        assert (sharing.decode(blob, groups) == np.where(mask, own, centres[groups])).all()
    for bad in (blob[:-1], blob + b"x", b"", sharing.encode(centres * 0, groups, own), sharing.encode(centres, np.append(groups, 0), own)):
        with pytest.raises(ValueError):
            sharing.decode(bad, groups)
    with pytest.raises(ValueError):
        sharing.decode(sharing.encode(centres, groups, own * 0, np.ones(genes, bool)), groups)


def test_shuffled_coordinates(spark):
    spots = spark.createDataFrame([("s", i, f"l{i}", float(i), float(-i)) for i in range(20)], "sample_id string, i bigint, spot_id string, x double, y double")
    got = {r["i"]: (r["x"], r["y"], r["spot_id"]) for r in graph.shuffled_coordinates(spots, 29).collect()}
    order = np.random.default_rng(29).permutation(20)
    assert got == {i: (float(order[i]), float(-order[i]), f"l{i}") for i in range(20)}


def test_stream_of_results(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "sample_id string, arm string, status string, bytes bigint"
    for n in range(3):
        (src / f"{n}.json").write_text(f'{{"sample_id": "s{n}", "arm": "a", "status": "success", "bytes": {n}}}\n')
        coverage.follow(spark, str(src), schema, out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["sample_id"] for r in spark.read.parquet(out).collect()) == ["s0", "s1", "s2"]


def test_windows_of_events(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    got = coverage.counts(e)
    assert got.agg(F.sum("n")).first()[0] == e.count()
