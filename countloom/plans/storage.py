"""Registered queries of storage, validation and coding, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hashtree, layout, resume
from ..sources import archive, reader, tables
from ..sources.matrix import CountMatrix, few, from_tables
from ..sources.shared import fresh_path, materialise, together
from . import oracles
from .inputs import Query, members, results, tidy


def _matrix(f: Callable[[CountMatrix], DataFrame]) -> Query:
    return lambda spark, d: tidy(f(from_tables(spark, d)))


def _shape(m: CountMatrix) -> DataFrame:
    n = m.spots.groupBy("sample_id").agg(F.count("*").alias("rows"))
    return n.join(F.broadcast(m.genes.agg(F.count("*").alias("columns")))).select("sample_id", "rows", "columns")


def broken_parts(m: CountMatrix) -> DataFrame:
    """Compressed rows with something wrong in every sample: columns outside, falling pointers, values and a missing pointer."""
    pointers, entries = layout.compressed_parts(m)
    shape, of = _shape(m), lambda s: F.col("sample_id") == s
    bad = entries.join(few(shape), "sample_id").select(
        "sample_id", "pos", F.when(of("A") & (F.col("pos") % 1000 == 0), F.col("columns")).otherwise(F.col("g")).alias("minor"), F.when(of("R") & (F.col("pos") % 500 == 0), F.lit(-1).cast("bigint")).otherwise(F.col("v")).alias("v")
    )
    fallen = F.when(of("N") & (F.col("i") % 7 == 0) & (F.col("i") > 0), F.col("ptr") - 1000).otherwise(F.col("ptr"))
    last = shape.select("sample_id", "rows")
    ptr = pointers.join(few(last), "sample_id").where(~of("R") | (F.col("i") < F.col("rows"))).select("sample_id", F.col("i").alias("pos"), fallen.alias("ptr"))
    return reader.structural_faults(shape, ptr, bad)


def strict_parts(m: CountMatrix) -> DataFrame:
    c = m.counts.join(few(_shape(m)), "sample_id")
    v = F.when((F.col("i") + F.col("g")) % 97 == 0, F.lit(0).cast("bigint")).otherwise(F.col("v"))
    g = F.when((F.col("i") * 7 + F.col("g")) % 101 == 0, F.col("g") + F.col("columns")).otherwise(F.col("g"))
    once = c.select("sample_id", "i", g.alias("g"), v.alias("v"))
    twice = c.where((F.col("i") + F.col("g")) % 89 == 0).select("sample_id", "i", g.alias("g"), v.alias("v"))
    return reader.strict_faults(once.unionByName(twice), _shape(m))


def broken_metadata(m: CountMatrix) -> DataFrame:
    k = F.col("i") % 10
    spots = m.spots.where((F.col("sample_id") != "N") | (k != 5)).select(
        "sample_id", "i", F.when(k != 4, F.col("spot_id")).alias("spot_id"), F.when(k == 3, F.lit(float("nan"))).otherwise(F.col("x")).alias("x"), "y"
    )
    own = m.genes.join(few(m.spots.select("sample_id").distinct()))
    genes = own.where((F.col("sample_id") != "R") | (F.col("g") % 50 != 7)).select("sample_id", "g", F.when(F.col("g") % 100 != 9, F.col("gene_id")).alias("gene_id"))
    return reader.metadata_faults(spots, genes, _shape(m))


def _store_bundles(spark: SparkSession, d: str, spots: Callable[[DataFrame], DataFrame] = lambda x: x) -> str:
    """A folder with a bundle for each sample, in turn as compressed rows, compressed columns and dense rows in tiles."""
    import json

    m = from_tables(spark, d)
    shape = {r["sample_id"]: (r["rows"], r["columns"]) for r in _shape(m).collect()}
    folder = fresh_path(spark, "bundles")

    def store(at: int, s: str) -> None:
        path, encoding = f"{folder}/{s}", ("csr_matrix", "csc_matrix", "dense_array")[at % 3]
        own = CountMatrix(m.counts.where(F.col("sample_id") == s), m.spots.where(F.col("sample_id") == s), m.genes)
        spark.createDataFrame([(json.dumps({"encoding": encoding, "shape": shape[s]}),)], "value string").coalesce(1).write.text(f"{path}/header.json")
        spots(own.spots).drop("sample_id").write.parquet(f"{path}/spots")
        own.genes.write.parquet(f"{path}/genes")
        if encoding == "dense_array":
            layout.dense_tiles(own, shape[s][1], gap=layout.DENSE_GAP).select("i", "at", "values").write.parquet(f"{path}/dense")
        else:
            pointers, entries = layout.compressed_parts(own, by_row=encoding == "csr_matrix")
            major, minor = ("i", "g") if encoding == "csr_matrix" else ("g", "i")
            pointers.select(F.col(major).alias("pos"), "ptr").write.parquet(f"{path}/pointers")
            entries.select("pos", F.col(minor).alias("minor"), "v").write.parquet(f"{path}/entries")

    todo = [partial(store, at, s) for at, s in enumerate(sorted(shape))]
    for k in range(0, len(todo), 3):
        together(*todo[k : k + 3])
    return folder


def _read_own(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    """The tables' own matrices may be larger than what is accepted from elsewhere."""
    return reader.read_bundles(spark, folder, most=2**62, dims=2**62)


def bundles(spark: SparkSession, d: str) -> DataFrame:
    """All samples through bundles on disk, read back in one plan."""
    return tidy(_read_own(spark, _store_bundles(spark, d))[0])


def bundle_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with bundles, as rows: a row too few, labels that are not there, coordinates that are not finite."""

    def spoil(spots: DataFrame) -> DataFrame:
        of = lambda s: F.col("sample_id") == s
        kept = spots.where(~of("A") | (F.col("i") != 4))
        return kept.withColumn("spot_id", F.when(~of("N") | (F.col("i") % 10 != 4), F.col("spot_id"))).withColumn("x", F.when(of("R") & (F.col("i") % 7 == 3), F.lit(float("nan"))).otherwise(F.col("x")))

    return tidy(_read_own(spark, _store_bundles(spark, d, spoil))[3])


def _later(m: CountMatrix) -> DataFrame:
    """The cells of a later version: a row of A is one more each, one of N is gone, R is as it was."""
    row = lambda s, i: (F.col("sample_id") == s) & (F.col("i") == i)
    return m.counts.where(~row("N", 70)).withColumn("v", F.col("v") + row("A", 5).cast("bigint"))


def hash_tree(spark: SparkSession, d: str) -> DataFrame:
    return tidy(hashtree.tree(hashtree.leaves(from_tables(spark, d).counts)))


def block_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two versions compared by their stored trees."""
    m = from_tables(spark, d)
    a, b = materialise(m.counts, "cells"), materialise(_later(m), "cells")
    return tidy(hashtree.compare(a, b, *(materialise(hashtree.tree(hashtree.leaves(x)), "tree") for x in (a, b))))


def resumed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a cohort that fail at first, or always, taken up until each is done or out of attempts."""
    r = results(spark, d).select("sample_id", "arm", "n_lines", "n_counts")

    def work(due: DataFrame) -> DataFrame:
        failed = (F.col("n_lines") % 7 == 0) | (F.col("attempt") == 1) & (F.col("n_lines") % 3 == 0)
        return due.join(r, ["sample_id", "arm"]).select("sample_id", "arm", "attempt", F.when(failed, "failed").otherwise("success").alias("status"), F.when(~failed, F.col("n_counts") * 3).alias("bytes"))

    folder, keys = fresh_path(spark, "runs"), ["sample_id", "arm"]
    ledger = resume.run_all(r, keys, work, folder)
    per = ledger.groupBy(*keys).agg(F.count("*").alias("attempts"), F.max_by("status", "attempt").alias("status"))
    return tidy(per.join(resume.results(spark, folder, keys).select(*keys, "bytes"), keys, "left"))


def packages(spark: SparkSession, d: str) -> DataFrame:
    """Members packed into one archive a package and taken out again."""
    m = members(spark, d, "a").select(F.concat(F.lit("p"), F.col("archive_id").cast("string")).alias("package"), F.concat(F.lit("dir/"), F.col("member")).alias("path"), F.encode("sha256", "UTF-8").alias("payload"))
    out = archive.members_of(archive.pack_packages(m), ("countloom-package-v1",))
    return tidy(out.select(F.col("archive_id").alias("package"), F.col("member").alias("path"), "bytes", "sha256"))


def decoded_sink(spark: SparkSession, d: str) -> DataFrame:
    """Decoded cells, written where nothing is yet and read back."""
    path = fresh_path(spark, "decoded")
    tables.write_exclusive(archive.decode_archives(archive.encode_archives(from_tables(spark, d), 32)), path, ["sample_id"])
    return tidy(spark.read.schema(archive.CELLS).parquet(path).select("sample_id", "i", "g", "v"))


def gzip_sink(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "gzip")
    from_tables(spark, d).counts.write.option("compression", "gzip").parquet(path)
    return tidy(spark.read.schema("sample_id string, i bigint, g bigint, v bigint").parquet(path))


def csv_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with commas, quotes and nothing in them, through CSV and back."""
    c, path = spark.read.parquet(f"{d}/customer.parquet"), fresh_path(spark, "csv")
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    rows = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 9 != 0, label).alias("label"), F.col("c_acctbal").alias("balance"))
    tables.write_csv(rows, path)
    return tidy(tables.read_csv(spark, path, "k bigint, label string, balance double"))


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of results are good, torn, and of keys that occur twice."""
    r, path = results(spark, d), fresh_path(spark, "jsonl")
    line = F.to_json(F.struct("sample_id", "arm", "status", "total_bytes", "n_lines"))
    torn = F.when(F.col("n_lines") % 13 == 0, F.substring(line, 1, 20)).otherwise(line)
    r.select(torn.alias("value")).unionByName(r.where("n_lines % 4 = 0").select(torn.alias("value"))).write.text(path)
    good, bad, twice = tables.read_jsonl(spark, path, r.select("sample_id", "arm", "status", "total_bytes", "n_lines").schema, ["sample_id", "arm"])
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return tidy(count(good, "good").unionByName(count(bad, "bad")).unionByName(count(twice, "twice")))


def exclusive_sink(spark: SparkSession, d: str) -> DataFrame:
    """Results written where nothing is yet, by platform; a second write is refused and changes nothing."""
    r, path = results(spark, d).select("sample_id", "arm", "platform", "n_lines"), fresh_path(spark, "exclusive")
    tables.write_exclusive(r, path, ["platform"])
    try:
        tables.write_exclusive(r.limit(1), path, ["platform"])
        refused = False
    except AnalysisException as e:
        refused = e.getCondition() == "PATH_ALREADY_EXISTS"
    return tidy(spark.read.parquet(path).select("sample_id", "arm", F.col("platform").cast("string").alias("platform"), "n_lines", F.lit(refused).alias("refused")))


QUERIES: dict[str, Query] = {
    "io16_csv_labels": csv_labels,
    "io17_json_lines": json_lines,
    "io18_exclusive_sink": exclusive_sink,
    "io1_bundles": bundles,
    "io1_bundle_faults": bundle_faults,
    "a22_hash_tree": hash_tree,
    "p7_block_compare": block_compare,
    "c23_resumed_runs": resumed_runs,
    "io5_structural_faults": _matrix(broken_parts),
    "p4_strict_faults": _matrix(strict_parts),
    "p6_metadata_faults": _matrix(broken_metadata),
    "p7_exact_checks": lambda s, d: tidy(layout.compare_fields(from_tables(s, d), from_tables(s, d, "count"))),
    "p8_verified_archives": _matrix(lambda m: archive.verify(archive.decode_archives(a := materialise(archive.encode_archives(m, 32), "archives")), archive.decode_axes(a), m)),
    "m11_decoded_cells": _matrix(lambda m: archive.decode_archives(archive.encode_archives(m, 32))),
    "io11_exception_archives": _matrix(lambda m: archive.decode_archives(archive.encode_archives(m, 8, True))),
    "io12_packages": packages,
    "io13_comparator_cells": _matrix(lambda m: archive.decode_comparators(archive.comparator_archives(m))),
    "io13_comparator_columns": _matrix(lambda m: archive.decode_comparators(archive.comparator_archives(m, "CSC_BZIP2_9"))),
    "io14_external_cells": _matrix(lambda m: archive.decode_external(archive.external_archives(m))),
    "io15_exchange_cells": _matrix(lambda m: archive.decode_exchange(archive.exchange_files(m))),
    "io20_gzip_cells": gzip_sink,
    "io21_decoded_sink": decoded_sink,
}

_CELLS = oracles.of_matrix("SELECT sample_id, i, g, v FROM counts", "sample_id:s i:i g:i v:i")
_PTR = """,
per AS (SELECT sp.sample_id, sp.i, count(c.v) AS n FROM spots sp LEFT JOIN counts c ON c.sample_id = sp.sample_id AND c.i = sp.i GROUP BY 1, 2),
ptr0 AS (SELECT sample_id, i, CAST(coalesce(sum(n) OVER (PARTITION BY sample_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM per
  UNION ALL SELECT sample_id, max(i) + 1, CAST(sum(n) AS BIGINT) FROM per GROUP BY 1),
ptr1 AS (SELECT sample_id, i, CASE WHEN sample_id = 'N' AND i % 7 = 0 AND i > 0 THEN ptr - 1000 ELSE ptr END AS ptr FROM ptr0),
nn AS (SELECT sample_id, CAST(sum(n) AS BIGINT) AS nnz, max(i) + 1 AS rows FROM per GROUP BY 1)"""
_PLACES = """,
pl AS (SELECT *, (i + g) % 97 = 0 AS z, (i * 7 + g) % 101 = 0 AS o, (i + g) % 89 = 0 AS w FROM counts)"""

#: A hash tree from ``leafs(sample_id, i, n, h)``: ``_levels(x)`` adds x1 to x4.
def _levels(x: str, cells: str) -> str:
    out = f""",
{x}0 AS (SELECT sample_id, i AS node, count(*) AS cells, sha256(i || '|' || string_agg(g || ':' || v, ',' ORDER BY g)) AS h FROM {cells} GROUP BY 1, 2)"""
    for n in range(1, 5):
        out += f""",
{x}{n} AS (SELECT sample_id, node // 64 AS node, sum(cells) AS cells, sha256(string_agg(node || '=' || h, ',' ORDER BY node)) AS h FROM {x}{n - 1} GROUP BY 1, 2)"""
    return out


_LATER = """,
later AS (SELECT sample_id, i, g, v + CASE WHEN sample_id = 'A' AND i = 5 THEN 1 ELSE 0 END AS v FROM counts WHERE NOT (sample_id = 'N' AND i = 70)),
per AS (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, count(*) FILTER (a.v = b.v) AS equal, count(*) FILTER (a.v <> b.v) AS changed, count(*) FILTER (b.v IS NULL) AS only_a, count(*) FILTER (a.v IS NULL) AS only_b
        FROM counts a FULL JOIN later b ON a.sample_id = b.sample_id AND a.i = b.i AND a.g = b.g GROUP BY 1)"""



ORACLE: dict[str, str] = {
    "io16_csv_labels": "SELECT CAST(c_custkey AS BIGINT) AS k, CASE WHEN c_custkey % 9 <> 0 THEN c_name || ', \"' || c_mktsegment || '\"' END AS label, round(c_acctbal, 6) AS balance FROM customer",
    "io17_json_lines": oracles.RESULTS + ", l AS (SELECT n_lines FROM r UNION ALL SELECT n_lines FROM r WHERE n_lines % 4 = 0) SELECT 'good' AS kind, count(*) FILTER (WHERE n_lines % 13 <> 0) AS n FROM l UNION ALL SELECT 'bad', count(*) FILTER (WHERE n_lines % 13 = 0) FROM l UNION ALL SELECT 'twice', count(*) FILTER (WHERE n_lines % 4 = 0 AND n_lines % 13 <> 0) FROM r",
    "io18_exclusive_sink": oracles.RESULTS + "SELECT sample_id, arm, platform, CAST(n_lines AS BIGINT) AS n_lines, true AS refused FROM r",
    "io1_bundle_faults": oracles.of_matrix("SELECT 'A' AS sample_id, 'spot_count' AS fault, 1 AS n UNION ALL SELECT 'N', 'spot_label', count(*) FROM s WHERE i % 10 = 4 UNION ALL SELECT 'R', 'coordinates', count(*) FROM s WHERE i % 7 = 3", "sample_id:s fault:s n:i"),
    "a22_hash_tree": oracles.of_matrix(" UNION ALL ".join(f"SELECT sample_id, {n} AS level, node, cells, h AS sha256 FROM t{n}" for n in range(1, 5)), "sample_id:s level:i node:i cells:i sha256:s", _levels("t", "counts")),
    "p7_block_compare": oracles.of_matrix(
        "SELECT per.*, changed + only_a + only_b = 0 AS identical, nodes, differing FROM per JOIN (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, greatest(count(a.h), count(b.h)) AS nodes, count(*) FILTER (a.h IS DISTINCT FROM b.h) AS differing FROM t1 a FULL JOIN u1 b ON a.sample_id = b.sample_id AND a.node = b.node GROUP BY 1) USING (sample_id)",
        "sample_id:s equal:i changed:i only_a:i only_b:i identical:b nodes:i differing:i", _LATER, _levels("t", "counts"), _levels("u", "later"),
    ),
    "c23_resumed_runs": oracles.RESULTS + "SELECT sample_id, arm, CAST(CASE WHEN n_lines % 7 = 0 OR n_lines % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN n_lines % 7 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN n_lines % 7 <> 0 THEN CAST(n_counts * 3 AS BIGINT) END AS bytes FROM r",
    **{n: _CELLS for n in ("io1_bundles", "m11_decoded_cells", "io11_exception_archives", "io13_comparator_cells", "io13_comparator_columns", "io14_external_cells", "io15_exchange_cells", "io20_gzip_cells", "io21_decoded_sink")},
    "io5_structural_faults": oracles.of_matrix(
        "SELECT * FROM (SELECT sample_id, 'minor_range' AS fault, (nnz + 999) // 1000 AS n FROM nn WHERE sample_id = 'A' UNION ALL SELECT sample_id, 'value', (nnz + 499) // 500 FROM nn WHERE sample_id = 'R'"
        " UNION ALL SELECT sample_id, 'pointer_count', 1 FROM nn WHERE sample_id = 'R' UNION ALL SELECT nn.sample_id, 'last_pointer', 1 FROM nn JOIN ptr1 p ON p.sample_id = nn.sample_id AND p.i = CASE WHEN nn.sample_id = 'R' THEN nn.rows - 1 ELSE nn.rows END WHERE p.ptr <> nn.nnz"
        " UNION ALL SELECT sample_id, 'falling_pointer', count(*) FROM (SELECT sample_id, ptr, lead(ptr) OVER (PARTITION BY sample_id ORDER BY i) AS nx FROM ptr1) WHERE nx IS NOT NULL AND (nx < ptr OR ptr < 0) GROUP BY 1)",
        "sample_id:s fault:s n:i", _PTR,
    ),
    "p4_strict_faults": oracles.of_matrix(
        "SELECT sample_id, 'value' AS fault, sum(CASE WHEN z THEN CASE WHEN w THEN 2 ELSE 1 END ELSE 0 END) AS n FROM pl GROUP BY 1 HAVING n > 0 UNION ALL SELECT sample_id, 'outside', sum(CASE WHEN o THEN CASE WHEN w THEN 2 ELSE 1 END ELSE 0 END) AS n FROM pl GROUP BY 1 HAVING n > 0"
        " UNION ALL SELECT sample_id, 'repeated', count(*) FILTER (WHERE w) AS n FROM pl GROUP BY 1 HAVING n > 0",
        "sample_id:s fault:s n:i", _PLACES,
    ),
    "p6_metadata_faults": oracles.of_matrix(
        "SELECT 'N' AS sample_id, 'spot_count' AS fault, 1 AS n FROM nrow WHERE sample_id = 'N' AND EXISTS (SELECT 1 FROM s WHERE i % 10 = 5) UNION ALL SELECT sample_id, 'spot_label', count(*) FROM spots WHERE i % 10 = 4 GROUP BY 1 UNION ALL SELECT sample_id, 'coordinates', count(*) FROM spots WHERE i % 10 = 3 GROUP BY 1"
        " UNION ALL SELECT 'R', 'gene_count', 1 FROM nrow WHERE sample_id = 'R' AND EXISTS (SELECT 1 FROM gn WHERE g % 50 = 7) UNION ALL SELECT sample_id, 'gene_label', count(*) FROM samples CROSS JOIN gn WHERE g % 100 = 9 GROUP BY 1",
        "sample_id:s fault:s n:i",
    ),
    "p7_exact_checks": oracles.of_matrix(
        "SELECT sample_id, true AS shape, bool_and(y IS NOT NULL AND x IS NOT NULL) AS indptr, bool_and(y IS NOT NULL AND x IS NOT NULL) AS indices, bool_and(coalesce(x = y, false)) AS counts, true AS spot_ids, true AS gene_ids, true AS coordinates, bool_and(coalesce(x = y, false)) AS all_"
        " FROM (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, a.v AS x, b.v AS y FROM counts a FULL JOIN (SELECT l_returnflag AS sample_id, i, g, count(*) AS v FROM lineitem JOIN s ON l_suppkey = s_suppkey JOIN gn ON l_partkey = p_partkey GROUP BY 1, 2, 3) b ON a.sample_id = b.sample_id AND a.i = b.i AND a.g = b.g) GROUP BY 1",
        "sample_id:s shape:b indptr:b indices:b counts:b spot_ids:b gene_ids:b coordinates:b all=all_:b",
    ),
    "p8_verified_archives": "SELECT DISTINCT l_returnflag AS sample_id, true AS counts, true AS spot_ids, true AS coordinates, true AS gene_ids, true AS \"all\" FROM lineitem",
    "io12_packages": oracles.MEMBERS + "SELECT 'p' || CAST(archive_id AS VARCHAR) AS package, 'dir/' || member AS path, CAST(64 AS BIGINT) AS bytes, sha256(sha256) AS sha256 FROM a",
}
