"""Inputs of the registered queries, made of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint, doubles to 6 places."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(name))
    return df.select(*out)


def results(spark: SparkSession, d: str) -> DataFrame:
    """A cohort of runs measured from the line items: samples are orders modulo 40, arms are line numbers."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    s = (F.col("l_orderkey") % 40).cast("bigint")
    per = line.groupBy(s.alias("s"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("arm")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").cast("bigint").alias("n_counts"), F.sum("l_linenumber").cast("bigint").alias("model"))
    ok = F.col("n_counts") % 11 != 0
    sized = lambda c: F.when(ok, c)
    payload, framing = F.col("n_counts") * 3, F.col("n_lines") * 2
    return per.select(
        F.concat(F.lit("s"), F.lpad(F.col("s").cast("string"), 2, "0")).alias("sample_id"), "arm", F.when(ok, "success").otherwise("failed").alias("status"),
        F.element_at(F.array(*[F.lit(x) for x in ("ST", "Visium", "Xenium")]), (F.col("s") % 3 + 1).cast("int")).alias("platform"),
        F.when(F.col("s") % 2 == 0, "human").otherwise("mouse").alias("species"), F.concat(F.lit("o"), (F.col("s") % 5).cast("string")).alias("organ"),
        sized(payload + F.col("model") + framing).alias("total_bytes"), sized(payload).alias("payload"), sized(F.col("model")).alias("model"), sized(framing).alias("framing"),
        "n_counts", "n_lines", (F.col("s") % 7).alias("identity"),
    )


def members(spark: SparkSession, d: str, salt: str) -> DataFrame:
    """Archives are orders modulo 25, members are line numbers; ``salt`` marks what differs between generations."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    a = (F.col("l_orderkey") % 25).cast("bigint")
    per = line.groupBy(a.alias("archive_id"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("member")).agg(F.count("*").alias("bytes"), F.sum("l_quantity").cast("bigint").alias("q"))
    digest = F.sha2(F.concat_ws(":", "member", F.col("q").cast("string"), F.when(F.col("q") % 5 == 0, salt).otherwise("")), 256)
    kept = F.lit(True) if salt == "a" else F.col("q") % 7 != 0
    return per.where(kept).select("archive_id", "member", "bytes", digest.alias("sha256"))


def people(spark: SparkSession, d: str) -> DataFrame:
    """The customers as a cohort to select from."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("species"), (F.col("c_nationkey") % 5).cast("bigint").alias("organ"), F.col("c_acctbal").cast("double").alias("balance"))


# The members of archives of all kinds.
NAMES = (
    "metadata.bz2", "graph.bz2", "base_probability.bz2", "shared_odds.u32", "support.rans", "value_q1.bz2", "value_group.bz2", "value_base_k.bz2", "value_odds.u32", "value_cond_k.bz2", "values.rans",
    "manifest.json", "order_map.u32", "support_graph.bz2", "value_graph_tail.bz2",
)


def named_members(spark: SparkSession, d: str, salt: str) -> DataFrame:
    """Archives are orders modulo 25, members carry the names of real ones."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    a = (F.col("l_orderkey") % 25).cast("bigint")
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(NAMES) + 1).cast("int"))
    per = line.groupBy(a.alias("archive_id"), name.alias("member")).agg(F.count("*").alias("bytes"), F.sum("l_quantity").cast("bigint").alias("q"))
    digest = F.sha2(F.concat_ws(":", "member", F.col("q").cast("string"), F.when(F.col("q") % 5 == 0, salt).otherwise("")), 256)
    return per.select("archive_id", "member", "bytes", digest.alias("sha256"))
