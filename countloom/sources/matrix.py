"""Count matrices as long tables.

``counts(sample_id, i, g, v)`` holds positive cells only, ``spots(sample_id, i,
spot_id, x, y)`` the rows and ``genes(g, gene_id)`` the columns, joined by ordinal
(labels may repeat). Zero cells are never built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import U32
from ..operators.scan import scan
from .shared import materialise, together

MAX_DIM, MAX_CELLS = 2_000_000, 500_000_000


@dataclass(frozen=True)
class CountMatrix:
    counts: DataFrame
    spots: DataFrame
    genes: DataFrame


MAX_FEW = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """A table of a row each for samples, arms or the like, to be combined with many: broadcast, behind a check of its size.

    A row is under 50 bytes, so what is sent is under 50 MB.
    """
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    guarded = df.limit(MAX_FEW + 1).withColumn("_n", n).where(F.when(F.col("_n") > MAX_FEW, F.raise_error(F.lit("more rows than can be sent to every task")).cast("boolean")).otherwise(True))
    return F.broadcast(guarded.drop("_n"))


def ordinals(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the 0-based position of each row in ``key`` order (keys are distinct).

    Rows are range-partitioned and written once, as a range partitioning samples
    anew each time it runs; then they are numbered within ranges. So no task sorts or
    counts all rows, and the driver sees one count a range.
    """
    parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1000))
    ranged = materialise(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), name)
    lead, at = [], 0
    held = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    for p in range(parts):
        lead.append(at)
        at += held.get(p, 0)
    before = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in lead]), F.col("_part") + 1)
    return ranged.withColumn(name, F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1 + before).drop("_part")


def bad_value(v: Column) -> Column:
    """Not finite, not integral, negative or beyond 32 bits."""
    d = v.cast("double")
    return v.isNull() | F.isnan(d) | (d < 0) | (d > F.lit(float(U32))) | (d != F.floor(d))


def canonicalise(entries: DataFrame, by: tuple[str, ...] = ("sample_id", "i", "g"), distinct: bool = False) -> DataFrame:
    """Sums repeated cells, drops zeros, and fails on values out of range before or after summing. distinct: no cell repeats."""
    if distinct:
        return entries.select(*by, F.when(bad_value(F.col("v")), F.raise_error(F.lit("count values")).cast("bigint")).otherwise(F.col("v").cast("bigint")).alias("v")).where("v > 0")
    checked = entries.withColumn("v", F.when(bad_value(F.col("v")), F.raise_error(F.lit("count values"))).otherwise(F.col("v").cast("bigint")))
    summed = checked.groupBy(*by).agg(F.sum("v").alias("v")).where("v > 0")
    return summed.withColumn("v", F.when(F.col("v") > U32, F.raise_error(F.lit("summed count values")).cast("bigint")).otherwise(F.col("v")))


def invalid_entries(entries: DataFrame) -> DataFrame:
    """The entries that ``canonicalise`` would refuse."""
    return entries.where(bad_value(F.col("v")))


def from_dense(rows: DataFrame) -> DataFrame:
    """(i, values array) to cells, zeros left out. Rows may be in tiles: ``at`` is the column that a tile begins with, null for a whole row."""
    at = F.coalesce(F.col("at"), F.lit(0)) if "at" in rows.columns else F.lit(0)
    return rows.select("i", at.alias("_at"), F.posexplode("values").alias("g", "v")).where("v <> 0").select("i", (F.col("_at") + F.col("g")).alias("g"), "v")


def from_compressed(pointers: DataFrame, entries: DataFrame, major: str = "i", minor: str = "g", within: tuple[str, ...] = ()) -> DataFrame:
    """Compressed rows (or columns): pointers(major, ptr) with one more row than there are majors; entries(pos, minor, v).

    Each entry belongs to the major whose half-open range holds its position: ranges
    are exploded to positions and joined by equality, so no range join is needed.
    Both tables may hold many matrices, told apart by the columns ``within``.
    """
    # The end of a range is the next major's pointer, found by equality: no task orders all pointers.
    ends = pointers.select(*within, (F.col(major) - 1).alias(major), F.col("ptr").alias("hi"))
    ranges = pointers.select(*within, major, F.col("ptr").alias("lo")).join(ends, [*within, major]).where("hi > lo")
    places = ranges.select(*within, major, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"))
    return places.join(entries, [*within, "pos"]).select(*within, major, minor, "v")


def _cells(size: Column | None) -> Column:
    return F.count("*") if size is None else F.sum(size.cast("bigint"))


def row_pointers(counts: DataFrame, rows: DataFrame, major: str = "i", size: Column | None = None) -> DataFrame:
    """(sample_id, major, ptr_lo, ptr_hi): every row of ``rows``, empty ones too. size: how many cells a row of ``counts`` stands for, if not one."""
    per = counts.groupBy("sample_id", major).agg(_cells(size).alias("n"))
    sized = rows.select("sample_id", major).join(per, ["sample_id", major], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return scan(sized, ["sample_id"], [major], sums={"ptr_hi": "n"}).select("sample_id", major, (F.col("ptr_hi") - F.col("n")).alias("ptr_lo"), "ptr_hi")


def to_compressed(counts: DataFrame, rows: DataFrame, major: str = "i", minor: str = "g") -> DataFrame:
    """(sample_id, major, ptr_lo, ptr_hi, minors array, values array): every row of ``rows``, empty ones too. Arrays meet pointers after the scan."""
    per = counts.groupBy("sample_id", major).agg(F.array_sort(F.collect_list(F.struct(minor, "v"))).alias("e"))
    none = F.array().cast("array<bigint>")
    return row_pointers(counts, rows, major).join(per, ["sample_id", major], "left").select("sample_id", major, "ptr_lo", "ptr_hi", F.coalesce(F.col(f"e.{minor}"), none).alias("minors"), F.coalesce(F.col("e.v"), none).alias("vals"))


def pointer_faults(pointers: DataFrame) -> DataFrame:
    """Rows whose pointer falls, and a first pointer that is not zero."""
    x = scan(pointers, ["sample_id"], ["i"], rank="_at", lags={"before": "ptr"})
    return x.where((F.col("_at") == 0) & (F.col("ptr") != 0) | (F.col("ptr") < F.col("before"))).drop("_at")


def budget(matrix: CountMatrix, size: Column | None = None) -> DataFrame:
    """(sample_id, n, genes, nnz, cells, within): sizes against the caps of one sample. size: as of ``row_pointers``."""
    genes = matrix.genes.agg(F.count("*").alias("genes"))
    n = matrix.spots.groupBy("sample_id").agg(F.count("*").alias("n"))
    nnz = matrix.counts.groupBy("sample_id").agg(_cells(size).alias("nnz"))
    sized = n.join(F.broadcast(genes)).join(nnz, "sample_id", "left").withColumn("nnz", F.coalesce("nnz", F.lit(0)))
    cells = F.col("n") * F.col("genes")
    return sized.select("sample_id", "n", "genes", "nnz", cells.alias("cells"), ((F.col("n").between(1, MAX_DIM)) & F.col("genes").between(1, MAX_DIM) & (cells <= MAX_CELLS)).alias("within"))


MEASURES = {"count": F.count, "quantity": F.sum, "tens": F.sum}


def from_tables(spark: SparkSession, sf_dir: str, measure: str = "quantity") -> CountMatrix:
    """The driver's tables as three samples (by return flag): suppliers are rows, parts are columns.

    measure: ``count`` of lines, ``quantity`` (their sum), or ``tens`` (sum of whole
    tens, which has explicit zeros).
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    s, g = together(lambda: ordinals(read("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey", "i"), lambda: ordinals(read("part").select("p_partkey", "p_name"), "p_partkey", "g"))
    value = {"count": F.lit(1), "quantity": F.col("l_quantity"), "tens": F.floor(F.col("l_quantity") / 10)}[measure]
    # Lines are combined by cell before they meet the axes, and read once.
    cells = read("lineitem").groupBy(F.col("l_returnflag").alias("sample_id"), "l_suppkey", "l_partkey").agg(F.sum(value.cast("bigint")).alias("v"))
    entries = cells.join(s.select("s_suppkey", "i"), F.col("l_suppkey") == F.col("s_suppkey")).join(g.select("p_partkey", "g"), F.col("l_partkey") == F.col("p_partkey"))
    entries = materialise(entries.select("sample_id", "i", "g", "v"), "entries")
    spots = s.select("i", F.col("s_suppkey").cast("string").alias("spot_id"), F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").cast("double").alias("y"))
    samples = entries.select("sample_id").distinct()
    return CountMatrix(canonicalise(entries, distinct=True), spots.join(few(samples)), g.select("g", F.col("p_name").alias("gene_id")))
