"""Text tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """Headed CSV of a given schema; a byte order mark is no part of the first name, and an empty value is null. Values with line breaks need ``multi_line``, and then a file is one task."""
    return spark.read.option("enforceSchema", "false").csv(path, header=True, schema=schema, encoding="UTF-8", multiLine=multi_line)


def write_csv(df: DataFrame, path: str) -> None:
    """Fails if there is something already."""
    df.write.mode("errorifexists").csv(path, header=True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, bad lines, keys that occur more than once). A torn last line is a bad line, not a failure."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    # Text and parse, so that asking for bad lines alone is allowed.
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    fine = rows.where("_bad is null").drop("_bad")
    return fine, rows.where("_bad is not null").select(F.col("_bad").alias("line")), fine.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def write_exclusive(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet under Spark's commit protocol; readers see all of it or nothing, and nothing is overwritten."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
