"""Hand-computed vectors, brute force and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.functions import fixed
from countloom.operators import coder, cohort, description, graph, layout, sharing, support, values
from countloom.operators.study import Study
from countloom.sources import archive, matrix
from countloom.sources.matrix import CountMatrix


def build(spark, dense: np.ndarray, coords: np.ndarray | None = None, sample: str = "s") -> CountMatrix:
    n, genes = dense.shape
    coords = coords if coords is not None else np.stack([np.arange(n), np.zeros(n)], 1)
    cells = [(sample, int(i), int(g), int(dense[i, g])) for i, g in zip(*np.nonzero(dense), strict=True)]
    counts = spark.createDataFrame(cells, "sample_id string, i bigint, g bigint, v bigint")
    spots = spark.createDataFrame([(sample, i, f"spot{i}", float(coords[i, 0]), float(coords[i, 1])) for i in range(n)], "sample_id string, i bigint, spot_id string, x double, y double")
    return CountMatrix(counts, spots, spark.createDataFrame([(g, f"g{g // 2}") for g in range(genes)], "g bigint, gene_id string"))


def as_map(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def smoke() -> np.ndarray:
    """8 x 5 with a zero row, a row of ones, a zero column and large values."""
    x = np.zeros((8, 5), np.int64)
    x[1], x[2, 0], x[3, 1], x[4, 2], x[5] = 1, 65, 257, 2**32 - 1, [2, 0, 3, 0, 0]
    x[6, 0], x[7, 3] = 1, 9
    x[:, 4] = 0
    return x


def test_groups_by_hand(spark):
    dense = np.zeros((4, 5), np.int64)
    for g, vs in enumerate(([1, 1, 1], [2, 2], [257], [2**32 - 1], [])):
        dense[: len(vs), g] = vs
    prof = {r["g"]: r for r in values.profiles(build(spark, dense)).collect()}
    assert [prof[g]["grp"] for g in range(5)] == [0, 0, 6, 7, 0]
    assert [prof[g]["tail_sum"] for g in range(5)] == [0, 2, 256, 4294967294, 0]


def test_quantise_by_hand(spark):
    rows = [("u", k, 1 / 32) for k in range(32)] + [("p", k, float(k == 0)) for k in range(32)]
    got = as_map(values.quantise(spark.createDataFrame(rows, "b string, k int, p double"), ["b"]), ("b", "k"), "freq")
    assert [got["u", k] for k in range(32)] == [128] * 32
    assert [got["p", k] for k in range(32)] == [4065] + [1] * 31


def test_centres_by_hand(spark):
    prof = spark.createDataFrame([("s", g, n, a, b) for g, (n, a, b) in enumerate([(0, 0, 0), (2, 2, 0), (100, 0, 1), (100, 100, 7)])], "sample_id string, g bigint, n bigint, a bigint, grp int")
    got = as_map(values.centres(prof), ("b",), "s")
    assert got[0,] == 3413 and got[2,] == 2048


def test_bucket_edges(spark):
    qs = [1, 4, 16, 64, 256, 1024, 2048, 3072, 3, 4095]
    got = spark.createDataFrame([(q,) for q in qs], "q int").select(fixed.bucket(F.col("q")).alias("b")).collect()
    assert [r["b"] for r in got] == [0, 1, 2, 3, 4, 5, 6, 7, 0, 7]


def test_odds_to_q_is_exact(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(q), int(r)) for q, r in zip(rng.integers(1, 4096, 500), rng.integers(22, 195360063, 500), strict=True)]
    got = spark.createDataFrame(pairs, "q int, r bigint").select(fixed.odds_to_q(F.col("q"), F.col("r")).alias("p")).collect()
    for (q, r), row in zip(pairs, got, strict=True):
        num = q * r
        den = num + (4096 - q) * 65536
        assert row["p"] == min(4095, max(1, (4096 * num + den // 2) // den))


@pytest.mark.parametrize("tile", [7, 64, graph.TILE])
@pytest.mark.parametrize("width", [0, 1, 6, 12])
def test_neighbours_against_brute_force(spark, monkeypatch, width, tile):
    monkeypatch.setattr(graph, "EPOCH", 1)
    rng = np.random.default_rng(width)
    xy = rng.integers(0, 12, (120, 2)).astype(float)  # many ties
    m = build(spark, np.eye(120, 2, dtype=np.int64), xy)
    got = {(r["i"], r["r"]): r["j"] for r in graph.causal_neighbours(m.spots, width, tile).collect()}
    want = {}
    for i in range(120):
        d = ((xy[:i] - xy[i]) ** 2).sum(1)
        for r, j in enumerate(np.lexsort((np.arange(i), d))[:width]):
            want[i, r + 1] = int(j)
    assert got == want
    assert graph.graph_faults(graph.causal_neighbours(m.spots, width), m.spots, width).count() == 0


def _layouts():
    rng = np.random.default_rng(4)
    grid = np.stack(np.meshgrid(np.arange(20.0), np.arange(18.0)), -1).reshape(-1, 2)
    return {
        # Places with hundreds of rows, far-off rows and rows in a line.
        "mixed": np.concatenate([np.full((150, 2), 3.0), rng.normal(size=(100, 2)) * 1e-3, rng.normal(size=(60, 2)) * 1e4, np.stack([np.arange(50.0), np.zeros(50)], 1)])[rng.permutation(360)],
        "one place": np.full((300, 2), -1.5), "line": np.stack([np.zeros(300), rng.random(300)], 1), "raster": grid, "raster backwards": grid[::-1], "far": np.concatenate([rng.random((300, 2)), [[1e12, -1e12]]]),
        # Late rows are far from all early ones.
        "apart": np.concatenate([rng.random((80, 2)), rng.random((240, 2)) + 1000]), "two": np.array([[0.0, 0.0], [1.0, 1.0]]), "one": np.array([[2.0, 2.0]]),
    }


@pytest.mark.parametrize("tile", [16, 100])
def test_neighbours_of_odd_layouts(spark, monkeypatch, tile):
    """All layouts as samples of one table, in small tiles."""
    monkeypatch.setattr(graph, "EPOCH", 1)
    layouts = _layouts()
    rows = [(name, i, float(x), float(y)) for name, xy in layouts.items() for i, (x, y) in enumerate(xy)]
    spots = spark.createDataFrame(rows, "sample_id string, i bigint, x double, y double").repartition(5)
    got = {(r["sample_id"], r["i"], r["r"]): (r["j"], r["d2"]) for r in graph.causal_neighbours(spots, 6, tile).collect()}
    n = 0
    for name, xy in layouts.items():
        for i in range(len(xy)):
            d = ((xy[:i] - xy[i]) ** 2)[:, 0] + ((xy[:i] - xy[i]) ** 2)[:, 1]
            want = np.lexsort((np.arange(i), d))[:6]
            assert [got[name, i, r + 1] for r in range(min(i, 6))] == [(j, d[j]) for j in want.tolist()], (name, i)
            n += len(want)
    assert n == len(got)


def test_crowded_tiles_are_split(spark):
    """A third of all rows at one place, most others in a spot a millionth as wide as the sample: tiles stay small, and so do lists of tiles."""
    rng = np.random.default_rng(9)
    n = 60_000
    xy = np.concatenate([np.full((n // 3, 2), 0.5), 0.5 + rng.normal(size=(n // 2, 2)) * 1e-6, rng.random((n - n // 3 - n // 2, 2))])[rng.permutation(n)]
    spots = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "sample_id string, i bigint, x double, y double")
    tiles = graph._tiles(spots, 6, graph.TILE)
    sizes = tiles.select(F.size("rows").alias("n")).toPandas().n
    assert sizes.max() <= graph.TILE and len(sizes) > 25
    got = graph.causal_neighbours(spots, 6)
    assert got.count() == sum(min(i, 6) for i in range(n))
    some = {i: [] for i in range(100, n, 1999)}
    for r in got.where(F.col("i").isin(list(some))).orderBy("i", "r").collect():
        some[r["i"]].append(r["j"])
    for i, js in some.items():
        d = ((xy[:i] - xy[i]) ** 2)[:, 0] + ((xy[:i] - xy[i]) ** 2)[:, 1]
        assert js == np.lexsort((np.arange(i), d))[:6].tolist()


def test_sufficient_statistics_against_dense(spark):
    rng = np.random.default_rng(51)
    dense = rng.poisson(0.7, (31, 11))
    st = Study(build(spark, dense), graph.previous_rows(build(spark, dense).spots))
    stats = support.sufficient_statistics(st.marginals(), st.late())
    q = {r["g"]: (r["b"], r["q0"]) for r in st.marginals().collect()}
    want: dict = {}
    for i in range(6, 31):
        for gene in range(11):
            b, q0 = q[gene]
            key = (b, int((dense[i - 6 : i, gene] > 0).sum()), q0)
            n, y = want.get(key, (0, 0))
            want[key] = n + 1, y + int(dense[i, gene] > 0)
    assert {(r["b"], r["k"], r["q"]): (r["n"], r["y"]) for r in stats.collect()} == want
    assert stats.agg(F.sum("n")).first()[0] == 25 * 11


def test_cells_of_all_widths_come_from_one_pass(spark):
    dense = np.random.default_rng(52).poisson(0.5, (25, 6)) * 3
    m = build(spark, dense, np.random.default_rng(53).random((25, 2)))
    g = graph.causal_neighbours(m.spots, 8).cache()
    near = {(r["i"], r["r"]): r["j"] for r in g.collect()}
    for r in support.neighbour_cells(m, g, (2, 8)).collect():
        for w in (2, 8):
            own = [dense[near[r["i"], k], r["g"]] for k in range(1, w + 1) if (r["i"], k) in near]
            assert (r[f"k{w}"], r[f"s{w}"]) == (sum(x > 0 for x in own), sum(own))
        assert (r["v"] or 0) == dense[r["i"], r["g"]]


def test_start_only_keeps_neutral_odds(spark):
    st = Study(build(spark, np.ones((5, 3), np.int64)))
    assert {r["odds"] for r in support.all_odds(st.support_odds(), st.m.spots.select("sample_id").distinct()).collect()} == {65536}


DENSE = {
    "smoke": smoke(), "zeros": np.zeros((8, 5), np.int64), "ones": np.ones((8, 5), np.int64), "diagonal": np.diag(np.arange(1, 14)) * 5, "one row": np.array([[4, 0, 1]]),
    "mixed": np.random.default_rng(77).choice([0, 0, 1, 1, 4, 5, 4097, 2**24 + 9, 2**32 - 1], (23, 40)),
}


@pytest.mark.parametrize("dense", DENSE.values(), ids=DENSE)
def test_entropy_round_trip(spark, dense):
    m = build(spark, dense, np.random.default_rng(1).random((len(dense), 2)))
    row = coder.round_trip(m).first()
    assert row["exact"] and row["tight"]
    assert abs(Study(m).support_bits().agg(F.sum("bits")).first()[0] - row["support_bits"]) < 1e-6


@pytest.mark.parametrize("k,exceptions", [(8, False), (32, False), (8, True), (32, True)])
def test_archives_are_decoded_from_themselves(spark, tmp_path, k, exceptions):
    m = build(spark, DENSE["mixed"], np.random.default_rng(1).random((23, 2)))
    archive.encode_archives(m, k, exceptions).write.parquet(str(tmp_path / "a"))
    files = spark.read.parquet(str(tmp_path / "a"))
    cells = archive.decode_archives(files)
    assert layout.reads_only(cells, str(tmp_path)) and not layout.reads_only(m.counts.unionByName(cells), "/nowhere")
    assert {(r["i"], r["g"]): r["v"] for r in cells.collect()} == {(i, g): DENSE["mixed"][i, g] for i, g in zip(*np.nonzero(DENSE["mixed"]), strict=True)}
    assert archive.verify(cells, archive.decode_axes(files), m).first()["all"]
    blob = bytes(files.first()["payload"])
    info, parts = archive.open_archive(blob, (archive.SCHEMA,), coder.MEMBERS)
    assert (info["groups"], info["mode"]) == (k, int(exceptions))
    other = m.counts.withColumn("v", F.when(F.col("i") == 3, F.col("v") % 7 + 1).otherwise(F.col("v")))
    row = archive.verify(cells, archive.decode_axes(files), CountMatrix(other, m.spots.withColumn("x", F.col("x") + 1), m.genes)).first()
    assert not row["counts"] and not row["coordinates"] and row["spot_ids"] and row["gene_ids"] and not row["all"]
    # Damage is refused, even behind a manifest that fits it; odds of contexts that do not occur may be any.
    for name in parts:
        bad = bytearray(parts[name])
        bad[len(bad) // 2] ^= 1
        if not name.endswith(".u32"):
            with pytest.raises(Exception):  # noqa: B017
                coder.decode_members({**parts, name: bytes(bad)}, info)
        with pytest.raises(Exception):  # noqa: B017
            coder.decode_members({**parts, name: parts[name][:-1]}, info)


def test_lanes_spend_what_symbols_cost():
    """And give the symbols back; damage is refused."""
    rng = np.random.default_rng(6)
    q = rng.integers(1, 4096, 5000)
    bits = rng.random(5000) < q / 4096
    start, freq = np.where(bits, 4096 - q, 0), np.where(bits, q, 4096 - q)
    many = coder.LaneWriter(16)
    many.put(start, freq)
    cost = float((12 - np.log2(freq)).sum())
    assert abs(8 * len(many.bytes()) - cost) < 50 + 48 * 16
    src = coder.LaneReader(many.bytes())
    assert (src.flags(q) == bits).all()
    src.close()
    for bad in (many.bytes()[:-2], many.bytes() + b"\0\0", b"\1\0\0\0\0\0\0\0", b"ab"):
        with pytest.raises(ValueError):
            r = coder.LaneReader(bad)
            r.flags(q)
            r.close()


def test_graphs_that_are_not_causal():
    good = np.array([[-1, -1], [0, -1], [1, 0], [0, 2]])
    assert coder.graph_ok(good)
    for i, r, j in ((1, 0, 1), (2, 1, 1), (0, 0, 0), (3, 1, -1), (1, 1, 0), (3, 0, 3)):
        bad = good.copy()
        bad[i, r] = j
        assert not coder.graph_ok(bad)


@pytest.mark.parametrize("k", [8, 32])
def test_shared_rates(k):
    rng = np.random.default_rng(k)
    centres, groups, own = rng.integers(1, 4096, k), rng.integers(0, k, 300), rng.integers(1, 4096, 300)
    mask = rng.random(300) < 0.2
    assert (sharing.decode(sharing.encode(centres, groups, own), groups, k) == centres[groups]).all()
    blob = sharing.encode(centres, groups, own, mask)
    assert (sharing.decode(blob, groups, k) == np.where(mask, own, centres[groups])).all()
    for bad in (blob[:-1], blob + b"x"):
        with pytest.raises(ValueError):
            sharing.decode(bad, groups, k)
    with pytest.raises(ValueError):
        sharing.decode(blob, groups[:-1], k)
    with pytest.raises(ValueError):
        sharing.decode(blob, groups, k + 1)


def test_digest_against_definition(spark):
    import hashlib

    x = DENSE["mixed"]
    i, g = np.nonzero(x)
    raw = b"".join(np.asarray(p).astype("<u8").tobytes() for p in (x.shape, np.concatenate([[0], np.cumsum((x > 0).sum(1))]), g, x[i, g]))
    assert coder.digest(build(spark, x)).first()["digest"] == hashlib.sha256(raw).hexdigest()


def test_comparators_and_exchange_files(spark):
    m = build(spark, DENSE["mixed"])
    assert all(r["exact"] and r["bytes"] > 0 for r in coder.comparators(m).collect()) and coder.comparators(m).count() == 6
    for encode, decode in (
        (archive.comparator_archives, archive.decode_comparators), (lambda x: archive.comparator_archives(x, "CSC_BZIP2_9"), archive.decode_comparators),
        (archive.external_archives, archive.decode_external), (lambda x: archive.external_archives(x, False), archive.decode_external), (archive.exchange_files, archive.decode_exchange),
    ):
        assert archive.cells_match(decode(encode(m)), m).first()["identical"]
    with pytest.raises(Exception, match="parameters"):
        archive.decode_comparators(archive.comparator_archives(m), 100).count()
    blob = archive.write_exchange(2, 3, np.array([0, 1, 1, 2]), np.array([1, 0]), np.array([5, 7]))
    assert [x.tolist() for x in archive.read_exchange(blob)[2:]] == [[0, 1, 1, 2], [1, 0], [5, 7]]
    for bad in (blob[:-1], blob + b"\0" * 4, b"\0" * 16 + blob[16:], archive.write_exchange(2, 3, np.array([0, 2, 1, 2]), np.array([1, 0]), np.array([5, 7])), archive.write_exchange(1, 3, np.array([0, 1, 1, 2]), np.array([1, 0]), np.array([5, 7]))):
        with pytest.raises(ValueError):
            archive.read_exchange(bad)
    with pytest.raises(ValueError):
        archive.bounded(__import__("bz2").compress(b"x" * 1000), 999)


def test_shuffled_groups_keep_sizes(spark, small):
    from countloom.plans import queries

    rows = queries.QUERIES["m20_shuffled_groups"](spark, small).collect()
    by = {(r["arm"], r["sample_id"]): r["bits"] for r in rows}
    assert len(by) == 6 and all(b > 0 for b in by.values()) and by["K32", "A"] != by["K32_shuffled", "A"]


def test_permutations_are_numpys(spark):
    m = build(spark, np.eye(9, 2, dtype=np.int64))
    got = sorted((r["place"], r["i"]) for r in layout.permuted_order(m.spots, 23).collect())
    assert [i for _, i in got] == np.random.default_rng(23).permutation(9).tolist()


@pytest.mark.parametrize("v", [1.5, -1.0, float("nan"), 4294967296.0, None])
def test_values_out_of_range(spark, v):
    bad = spark.createDataFrame([("s", 0, 0, v)], "sample_id string, i bigint, g bigint, v double")
    assert matrix.invalid_entries(bad).count() == 1
    with pytest.raises(Exception, match="count values"):
        matrix.canonicalise(bad).collect()


def test_canonical_sums_and_refuses_overflow(spark):
    schema = "sample_id string, i bigint, g bigint, v double"
    got = matrix.canonicalise(spark.createDataFrame([("s", 0, 0, 2.0), ("s", 0, 0, 3.0), ("s", 0, 1, 0.0), ("s", 1, 1, 4294967295.0)], schema)).collect()
    assert sorted((r["i"], r["g"], r["v"]) for r in got) == [(0, 0, 5), (1, 1, 4294967295)]
    with pytest.raises(Exception, match="summed"):
        matrix.canonicalise(spark.createDataFrame([("s", 0, 0, 4294967295.0), ("s", 0, 0, 1.0)], schema)).collect()


def test_dense_equals_compressed(spark):
    dense = np.array([[0, 2, 0], [3, 0, 1], [0, 0, 4]])
    a = matrix.from_dense(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(dense)], "i bigint, values array<bigint>"))
    by_row = matrix.from_compressed(spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 4)], "i bigint, ptr bigint"), spark.createDataFrame([(0, 1, 2), (1, 0, 3), (2, 2, 1), (3, 2, 4)], "pos bigint, g bigint, v bigint"))
    by_col = matrix.from_compressed(spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 4)], "g bigint, ptr bigint"), spark.createDataFrame([(0, 1, 3), (1, 0, 2), (2, 1, 1), (3, 2, 4)], "pos bigint, i bigint, v bigint"), "g", "i")
    get = lambda df: sorted((r["i"], r["g"], r["v"]) for r in df.select("i", "g", "v").collect())
    assert get(a) == get(by_row) == get(by_col)


def test_frames_and_archives():
    members = {"b": b"12", "a": b"", "c/d": bytes(range(256))}
    assert archive.unframe(archive.frame(members)) == members
    blob = archive.frame(members)
    for bad in (blob[:-1], blob + b"x", b"XXXX" + blob[4:]):
        with pytest.raises(ValueError):
            archive.unframe(bad)
    assert archive.unframe(blob, 3, 3) == members
    for limits in ((4, 64), (3, 2)):
        with pytest.raises(ValueError):
            archive.unframe(blob, *limits)
    z = archive.write_archive(members, "countloom-v1")
    assert z == archive.write_archive(dict(reversed(members.items())), "countloom-v1")
    assert archive.read_archive(z, ("countloom-v1",)) == members
    at = z.index(bytes(range(256)))
    for bad in (z[:at] + b"\xff" + z[at + 1 :],):
        with pytest.raises(Exception):  # noqa: B017
            archive.read_archive(bad, ("countloom-v1",))
    with pytest.raises(ValueError):
        archive.read_archive(z, ("other",))
    with pytest.raises(ValueError):
        archive.write_archive({"../x": b""}, "countloom-v1")


def test_archive_files(spark, tmp_path):
    z = archive.write_archive({"a": b"1", "b": b"22"}, "countloom-v1")
    (tmp_path / "one.zip").write_bytes(z)
    got = archive.members_of(archive.read_archives(spark, f"{tmp_path}/*.zip")).collect()
    assert [(r["member"], r["bytes"]) for r in sorted(got, key=lambda r: r["member"])] == [("a", 1), ("b", 2)]


def test_quota_keeps_rare_strata(spark):
    people = [(f"m{i}", "mouse", "ST", "brain") for i in range(10)] + [("h", "human", "HD", "kidney")]
    schema = "id string, species string, st string, organ string"
    take = lambda rows: sorted(r["id"] for r in cohort.quota(spark.createDataFrame(rows, schema), 6, ["species", "st", "organ"], F.sha2("id", 256)).collect())
    got = take(people)
    assert len(got) == 6 and "h" in got and got == take(people[::-1])


def test_rate_clusters_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(0, 40, 60)
    a = rng.binomial(n, rng.choice([0.1, 0.5, 0.9], 60))
    got = {r["g"]: (r["label"], r["centre"]) for r in description.cluster_rates(spark.createDataFrame([(g, int(x), int(y)) for g, (x, y) in enumerate(zip(n, a, strict=True))], "g bigint, n bigint, a bigint"), 4).collect()}
    rate = (a + 0.5) / (n + 1)
    label = np.empty(60, int)
    label[np.lexsort((np.arange(60), rate))] = np.arange(60) * 4 // 60
    label[n == 0] = 0
    centre = [2048] * 4
    for step in range(21):
        for k in range(4):
            big_n, big_a = int(n[label == k].sum()), int(a[label == k].sum())
            if big_n:
                centre[k] = min(4095, max(1, (4096 * (2 * big_a + 1) + big_n + 1) // (2 * (big_n + 1))))
        if step == 20:
            break
        cost = np.stack([-a * np.log(c / 4096) - (n - a) * np.log1p(-c / 4096) for c in centre], 1)
        label = np.where(n == 0, 0, cost.argmin(1))
    assert got == {g: (int(label[g]), centre[label[g]]) for g in range(60)}


def test_description_against_sums(spark, small):
    """All twelve arms of a sample, by plain loops over its events; the choice is the cheapest arm."""
    from countloom.plans import queries
    from countloom.sources.matrix import from_tables

    st = Study(from_tables(spark, small))
    prof, events = st.profiles().toPandas(), st.events().toPandas()
    odds = {(r["sample_id"], r["b"], r["c"]): int(r["odds"]) for r in st.value_odds().collect()}
    labels = description.cluster_samples(st.profiles().select("sample_id", "g", "n", "a"), rounds=3)
    got = {(r["sample_id"], r["k"], r["exceptions"]): r for r in description.description_lengths(st.profiles(), labels, st.events(), st.value_odds()).collect()}
    centre = {(r["sample_id"], r["k"], r["g"]): r["centre"] for r in labels.collect()}

    def rate(s, b, c, q):
        if c == 7:
            return q
        num = q * odds.get((s, b, c), 65536)
        den = num + (4096 - q) * 65536
        return min(4095, max(1, (4096 * num + den // 2) // den))

    for s in ("A", "N"):
        own = prof[prof.sample_id == s]
        seen = events[events.sample_id == s].assign(one=lambda e: e.v == 1).groupby(["g", "c", "one"]).size().to_dict()
        by_gene = {}
        for (g, c, one), n in seen.items():
            by_gene.setdefault(g, []).append((c, one, n))
        for k in description.KS:
            for flag in (False, True):
                bits, kept = 0.0, 0
                for r in own.itertuples():
                    new = centre[s, k, r.g]
                    pairs = [(rate(s, r.grp, c, int(r.q)), rate(s, r.grp, c, new)) for c in range(8)]
                    loss = r.a * max(math.log2(x / y) for x, y in pairs) + (r.n - r.a) * max(math.log2((4096 - x) / (4096 - y)) for x, y in pairs) + 1e-10 * r.n
                    keep = flag and any(x != y for x, y in pairs) and loss > 12
                    kept += keep
                    for c, one, n in by_gene.get(r.g, []):
                        p = rate(s, r.grp, c, int(r.q) if keep else new)
                        bits += n * (12 - math.log2(p if one else 4096 - p))
                row = got[s, k, flag]
                model = len(own) * math.log2(k) + 12 * k + (len(own) + 12 * kept if flag else 0)
                assert row["n_exceptions"] == kept and row["model_bits"] == pytest.approx(model) and row["singleton_bits"] == pytest.approx(bits) and row["bytes"] == math.ceil(round(model + bits, 5) / 8)
        best = min((r["bytes"], r["k"], r["exceptions"]) for key, r in got.items() if key[0] == s)
        assert [(r["bytes"], r["k"], r["exceptions"]) for key, r in got.items() if key[0] == s and r["selected"]] == [best]
    chosen = queries.QUERIES["m6_description_length"](spark, small).where("selected")
    assert chosen.count() == 3


def test_empty_matrix(spark):
    m = build(spark, np.zeros((3, 2), np.int64))
    assert Study(m).value_bits().count() == 0
    assert coder.round_trip(m).first()["exact"]


def test_rate_clusters_of_all_samples(spark, small):
    from countloom.plans import queries
    from countloom.sources.matrix import from_tables

    got = queries.QUERIES["m6_rate_clusters"](spark, small).toPandas()
    prof = values.profiles(from_tables(spark, small)).select("sample_id", "g", "n", "a").toPandas()
    samples = sorted(prof["sample_id"].unique())
    assert len(samples) == 3 and sorted(got[["sample_id", "k"]].drop_duplicates().itertuples(index=False, name=None)) == [(s, k) for s in samples for k in (1, 2, 4, 8, 16, 32)]
    assert len(got) == 6 * len(prof)
    for s in samples:
        own = description.cluster_rates(spark.createDataFrame(prof[prof["sample_id"] == s].drop(columns="sample_id")), 4).collect()
        mine = got[(got["sample_id"] == s) & (got["k"] == 4)]
        assert sorted(map(tuple, own)) == sorted(mine[["g", "label", "centre"]].itertuples(index=False, name=None))


def test_compressed_cells_of_all_samples(spark, small):
    from countloom.operators import layout
    from countloom.sources.matrix import from_tables

    m = from_tables(spark, small)
    cells = lambda df: sorted(map(tuple, df.select("sample_id", "i", "g", "v").collect()))
    assert cells(layout.round_trip_compressed(m)) == cells(m.counts)


def test_shuffled_neighbours_of_all_seeds(spark, small):
    from countloom.plans import queries
    from countloom.sources.matrix import from_tables

    got = queries.QUERIES["j4_shuffled_neighbours"](spark, small).toPandas()
    assert sorted(got["seed"].unique()) == [11, 29, 47]
    spots = from_tables(spark, small).spots
    for seed in (11, 47):
        want = graph.causal_neighbours(graph.shuffled_coordinates(spots, seed)).select("sample_id", "i", "r", "j").collect()
        assert sorted(map(tuple, want)) == sorted(got[got["seed"] == seed][["sample_id", "i", "r", "j"]].itertuples(index=False, name=None))
