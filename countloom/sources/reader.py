"""Matrices out of storage: dense rows, compressed rows or compressed columns, behind structural checks.

A bundle is a folder with ``header.json`` (encoding and shape) and Parquet tables:
``dense(i, values)`` or, in tiles, ``dense(i, at, values)`` (zeros where there is no tile), or ``pointers(pos, ptr)`` and ``entries(pos, minor, v)``; labels
and coordinates in ``spots(i, spot_id, x, y)`` and ``genes(g, gene_id)``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import MAX_DIM, CountMatrix, bad_value, canonicalise, few, from_compressed, from_dense
from .shared import materialise

MAX_ENTRIES = 100_000_000
ENCODINGS = ("dense_array", "csr_matrix", "csc_matrix")


def structural_faults(shape: DataFrame, pointers: DataFrame, entries: DataFrame, by_row: bool = True, most: int = MAX_ENTRIES, dims: int = MAX_DIM) -> DataFrame:
    """(sample_id, fault, n) of compressed matrices: shape(sample_id, rows, columns), pointers(sample_id, pos, ptr), entries(sample_id, pos, minor, v).

    Faults: shape, pointer_count, entry_budget, first_pointer, last_pointer,
    falling_pointer, minor_range, value. Pointers are compared with their successors by
    equality of places, so no task orders a whole matrix.
    """
    major, minor = ("rows", "columns") if by_row else ("columns", "rows")
    p = pointers.groupBy("sample_id").agg(F.count("*").alias("pointers"), F.min_by("ptr", "pos").alias("first"), F.max_by("ptr", "pos").alias("last"))
    after = pointers.select("sample_id", (F.col("pos") - 1).alias("pos"), F.col("ptr").alias("next"))
    falls = pointers.join(after, ["sample_id", "pos"]).where("next < ptr or ptr < 0").groupBy("sample_id").agg(F.count("*").alias("falls"))
    wide = few(shape.select("sample_id", F.col(minor).alias("_minors")))
    e = entries.join(wide, "sample_id").groupBy("sample_id").agg(
        F.count("*").alias("entries"), F.count(F.when((F.col("minor") < 0) | (F.col("minor") >= F.col("_minors")), 1)).alias("outside"), F.count(F.when(bad_value(F.col("v")), 1)).alias("bad")
    )
    x = shape.join(p, "sample_id", "left").join(falls, "sample_id", "left").join(e, "sample_id", "left").na.fill(0, ["pointers", "falls", "entries", "outside", "bad"])
    one = lambda c: F.coalesce(c, F.lit(True)).cast("bigint")
    found = {
        "shape": (~F.col("rows").between(1, dims)).cast("bigint") + (~F.col("columns").between(1, dims)).cast("bigint"),
        "pointer_count": one(F.col("pointers") != F.col(major) + 1),
        "entry_budget": one(F.col("entries") > most),
        "first_pointer": one(F.col("first") != 0),
        "last_pointer": one(F.col("last") != F.col("entries")),
        "falling_pointer": F.col("falls"),
        "minor_range": F.col("outside"),
        "value": F.col("bad"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), v.cast("bigint").alias("n")) for k, v in found.items()]))
    return x.select("sample_id", each.alias("f")).select("sample_id", "f.fault", "f.n").where("n > 0")


def noncanonical(entries: DataFrame, by: tuple[str, ...] = ("sample_id", "i", "g")) -> DataFrame:
    """(sample_id, fault, n) of cells that a decoder must not repair: repeated, zero."""
    per = entries.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("v") == 0, 1)).alias("z"))
    all_ = per.groupBy("sample_id").agg(F.sum(F.col("n") - 1).alias("repeated"), F.sum("z").alias("zero"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in ("repeated", "zero")]))
    return all_.select("sample_id", each.alias("f")).select("sample_id", "f.fault", "f.n").where("n > 0")


def strict_faults(counts: DataFrame, shape: DataFrame) -> DataFrame:
    """(sample_id, fault, n) of cells that are to be canonical already: value, outside, repeated."""
    x = counts.join(few(shape), "sample_id")
    per = x.groupBy("sample_id", "i", "g").agg(
        F.count("*").alias("n"), F.count(F.when(bad_value(F.col("v")) | (F.col("v") == 0), 1)).alias("value"),
        F.count(F.when(~F.col("i").between(0, F.col("rows") - 1) | ~F.col("g").between(0, F.col("columns") - 1), 1)).alias("outside"),
    )
    all_ = per.groupBy("sample_id").agg(F.sum("value").alias("value"), F.sum("outside").alias("outside"), F.sum(F.col("n") - 1).alias("repeated"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in ("value", "outside", "repeated")]))
    return all_.select("sample_id", each.alias("f")).select("sample_id", "f.fault", "f.n").where("n > 0")


def metadata_faults(spots: DataFrame, genes: DataFrame, shape: DataFrame) -> DataFrame:
    """(sample_id, fault, n): labels(sample_id, pos, label) and coordinates that do not fit the shape.

    Faults: spot_count, gene_count, spot_label, gene_label, coordinates. Labels may repeat; places may not.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    s = spots.groupBy("sample_id").agg(F.countDistinct("i").alias("ns"), F.count("*").alias("cs"), F.count(F.when(F.col("spot_id").isNull(), 1)).alias("ls"), F.count(F.when(~(finite("x") & finite("y")), 1)).alias("xy"))
    g = genes.groupBy("sample_id").agg(F.countDistinct("g").alias("ng"), F.count("*").alias("cg"), F.count(F.when(F.col("gene_id").isNull(), 1)).alias("lg"))
    x = shape.join(s, "sample_id", "left").join(g, "sample_id", "left").na.fill(0)
    found = {
        "spot_count": ((F.col("ns") != F.col("rows")) | (F.col("cs") != F.col("rows"))).cast("bigint"), "gene_count": ((F.col("ng") != F.col("columns")) | (F.col("cg") != F.col("columns"))).cast("bigint"),
        "spot_label": F.col("ls"), "gene_label": F.col("lg"), "coordinates": F.col("xy"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), v.alias("n")) for k, v in found.items()]))
    return x.select("sample_id", each.alias("f")).select("sample_id", "f.fault", "f.n").where("n > 0")


def _misshapen(dense: DataFrame, columns: Column, rows: Column) -> Column:
    """Rows that are not as long as there are columns, tiles that reach beyond them, and rows that are not there."""
    size, whole = F.size("values"), F.size("values") != columns
    if "at" in dense.columns:
        whole = F.when(F.col("at").isNull(), whole).otherwise((F.col("at") < 0) | (F.col("at") + size > columns) | (size < 1))
    return F.coalesce(whole, F.lit(True)) | ~F.col("i").between(0, rows - 1)


def read_bundle(spark: SparkSession, path: str, sample_id: str = "") -> CountMatrix:
    """The matrix of a bundle; whatever is wrong with it is a ValueError that says what."""
    try:
        header = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/header.json", wholetext=True).collect()))
        encoding, (n, genes) = header["encoding"], (int(d) for d in header["shape"])
        if encoding not in ENCODINGS:
            raise ValueError(f"unknown encoding {encoding}")
        own = lambda t: spark.read.parquet(f"{path}/{t}").withColumn("sample_id", F.lit(sample_id))
        shape = spark.createDataFrame([(sample_id, n, genes)], "sample_id string, rows bigint, columns bigint")
        spots, labels = own("spots"), own("genes")
        faults = metadata_faults(spots, labels, shape)
        if encoding == "dense_array":
            dense = own("dense")
            cells = from_dense(dense).withColumn("sample_id", F.lit(sample_id))
            wrong = dense.where(_misshapen(dense, F.lit(genes), F.lit(n))).select("sample_id", F.lit("shape").alias("fault"), F.lit(1).cast("bigint").alias("n"))
            faults = faults.unionByName(wrong)
        else:
            by_row = encoding == "csr_matrix"
            pointers, entries = own("pointers"), own("entries")
            faults = faults.unionByName(structural_faults(shape, pointers, entries, by_row))
            major, minor = ("i", "g") if by_row else ("g", "i")
            cells = from_compressed(pointers.withColumnRenamed("pos", major), entries.withColumnRenamed("minor", minor), major, minor, ("sample_id",))
        if found := faults.limit(20).collect():
            raise ValueError("; ".join(f"{r['fault']}: {r['n']}" for r in found))
        return CountMatrix(canonicalise(cells.select("sample_id", "i", "g", "v")), spots.select("sample_id", "i", "spot_id", "x", "y"), labels.select("g", "gene_id"))
    except ValueError:
        raise
    except Exception as e:
        raise ValueError(f"not a bundle: {path}") from e


_BUNDLE = {
    "spots": "i bigint, spot_id string, x double, y double", "genes": "g bigint, gene_id string", "dense": "i bigint, at bigint, values array<bigint>", "pointers": "pos bigint, ptr bigint", "entries": "pos bigint, minor bigint, v bigint",
}


def _bundle_of(table: str) -> Column:
    """The folder that holds the table, itself a folder of files or one file. No expression is matched: a name is found for every row."""
    path = F.col("_metadata.file_path")
    last = F.substring_index(path, "/", -2)
    inside = F.when(F.startswith(last, F.lit(f"{table}/")), F.substring_index(F.substring_index(path, "/", -3), "/", 1))
    return inside.when(F.endswith(last, F.lit(f"/{table}")), F.substring_index(last, "/", 1)).otherwise("").alias("sample_id")


def read_bundles(spark: SparkSession, folder: str, most: int = MAX_ENTRIES, dims: int = MAX_DIM) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, spots, genes, faults) of all bundles in a folder, in one plan however many there are.

    A bundle's sample_id is its folder's name. Headers are a table; each table of all
    bundles is one scan, and a bundle's encoding decides, by a join, how its rows are
    read. The driver sees which encodings occur, no more. Faults (sample_id, fault, n)
    are rows, of all kinds that ``read_bundle`` refuses, and ``encoding`` for one that is
    unknown or a header that cannot be read; cells and labels are those of bundles without a
    fault. A file whose columns have other types than a bundle's ends the read. most, dims: entries, and rows or
    columns, that a compressed bundle may have; for one's own bundles there need be no limit.
    """
    name = _bundle_of
    raw = spark.read.text(f"{folder}/*/header.json", wholetext=True).select(name("header.json"), F.from_json("value", "encoding string, shape array<bigint>").alias("h"))
    headers = raw.select("sample_id", F.col("h.encoding").alias("encoding"), F.try_element_at("h.shape", F.lit(1)).alias("rows"), F.try_element_at("h.shape", F.lit(2)).alias("columns"))
    known = F.col("encoding").isin(*ENCODINGS) & F.col("rows").isNotNull() & F.col("columns").isNotNull()
    # Names with bundles of an encoding, at most three rows.
    there = {r["encoding"] for r in headers.where(known).select("encoding").distinct().collect()}
    shape = headers.where(known).select("sample_id", "encoding", "rows", "columns")
    faults = headers.where(F.coalesce(~known, F.lit(True))).select("sample_id", F.lit("encoding").alias("fault"), F.lit(1).cast("bigint").alias("n"))

    def table(t: str, *of: str) -> DataFrame:
        rows = spark.read.schema(_BUNDLE[t]).parquet(f"{folder}/*/{t}") if not of or there & set(of) else spark.createDataFrame([], f"{_BUNDLE[t]}")
        # The name is taken of the scan itself; a table that is not there has no rows to name.
        named = rows.select(name(t), "*") if not of or there & set(of) else rows.select(F.lit("").alias("sample_id"), "*")
        return named.join(few(shape.where(F.col("encoding").isin(*of)).select("sample_id")), "sample_id") if of else named

    spots, genes, dense = table("spots"), table("genes"), table("dense", "dense_array")
    faults = faults.unionByName(metadata_faults(spots, genes, shape.drop("encoding")))
    sized = dense.join(few(shape.select("sample_id", "rows", "columns")), "sample_id")
    wrong = sized.where(_misshapen(sized, F.col("columns"), F.col("rows")))
    faults = faults.unionByName(wrong.groupBy("sample_id").agg(F.count("*").alias("n")).select("sample_id", F.lit("shape").alias("fault"), "n"))
    cells = dense.select("sample_id", "i", F.coalesce("at", F.lit(0)).alias("at"), F.posexplode("values").alias("g", "v")).where("v <> 0 or v is null").select("sample_id", "i", (F.col("at") + F.col("g")).alias("g"), "v")
    faults, packed = faults.unionByName(invalid_cells(cells)), []
    for encoding, major, minor in (("csr_matrix", "i", "g"), ("csc_matrix", "g", "i")):
        if encoding in there:
            pointers, entries = table("pointers", encoding), table("entries", encoding)
            faults = faults.unionByName(structural_faults(shape.where(F.col("encoding") == encoding).drop("encoding"), pointers, entries, encoding == "csr_matrix", most, dims))
            own = from_compressed(pointers.withColumnRenamed("pos", major), entries.withColumnRenamed("minor", minor), major, minor, ("sample_id",))
            packed.append(own.select("sample_id", "i", "g", "v"))
            cells = cells.unionByName(packed[-1])
    faults = materialise(faults.where("n > 0"), "faults")
    # Entries have been looked at; the cells they make are looked at where one of them is out of range.
    out = faults.where("fault = 'value'").select("sample_id").distinct()
    if packed and not out.isEmpty():
        faults = materialise(reduce(DataFrame.unionByName, [faults, *(invalid_cells(c.join(few(out), "sample_id")) for c in packed)]), "faults")
    # A row for each bundle at most.
    bad = few(faults.select("sample_id").distinct())
    cells, spots, genes = (t.join(bad, "sample_id", "left_anti") for t in (cells, spots, genes))
    return canonicalise(cells), spots, genes, faults


def invalid_cells(cells: DataFrame) -> DataFrame:
    """(sample_id, fault, n) of values out of range."""
    return cells.groupBy("sample_id").agg(F.count(F.when(bad_value(F.col("v")), 1)).alias("n")).where("n > 0").select("sample_id", F.lit("value").alias("fault"), "n")
