"""Work that is taken up where it was left: planned keys, a ledger of what is done, and results that count once they are in it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ledger(spark: SparkSession, folder: str, keys: dict[str, str]) -> DataFrame:
    """(keys, attempt, status, run) so far."""
    schema = ", ".join(f"`{k}` {t}" for k, t in keys.items()) + ", attempt bigint, status string, run string"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # Nothing is done yet.
        return spark.createDataFrame([], schema)


def outstanding(plan: DataFrame, ledger: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, attempt): planned keys without a success and with attempts left, and the number of the attempt that is due."""
    done = ledger.groupBy(*keys).agg(F.max("attempt").alias("_n"), F.bool_or(F.col("status") == "success").alias("_ok"))
    due = plan.select(*keys).distinct().join(done, keys, "left").where(~F.coalesce("_ok", F.lit(False)) & (F.coalesce("_n", F.lit(0)) < most))
    return due.select(*keys, (F.coalesce("_n", F.lit(0)) + 1).alias("attempt"))


def run_once(plan: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], folder: str, most: int = 2) -> int:
    """One round over what is outstanding; returns how many keys that were.

    ``work`` takes (keys, attempt) and gives rows of (keys, attempt, status, ...). They are
    written under a folder of this round's own, and only then entered in the ledger, by
    one append that Spark commits whole. Whatever ends a round before that leaves rows that
    no reader sees, and the next round does the same keys again under another folder; so
    nothing is lost and nothing counts twice. Rounds of one folder run one at a time.
    """
    spark, kinds = plan.sparkSession, {k: plan.schema[k].dataType.simpleString() for k in keys}
    due = outstanding(plan, _ledger(spark, folder, kinds), keys, most)
    run = uuid.uuid4().hex
    work(due).write.parquet(f"{folder}/results/run={run}")
    written = spark.read.parquet(f"{folder}/results/run={run}").select(*keys, F.col("attempt").cast("bigint").alias("attempt"), "status", F.lit(run).alias("run"))
    n = written.count()
    if n:
        written.write.mode("append").parquet(f"{folder}/ledger")
    return n


def run_all(plan: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], folder: str, most: int = 2) -> DataFrame:
    """Rounds until nothing is outstanding, at most ``most`` of them; the ledger."""
    for _ in range(most):
        if not run_once(plan, keys, work, folder, most):
            break
    return _ledger(plan.sparkSession, folder, {k: plan.schema[k].dataType.simpleString() for k in keys})


def results(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The rows of successful attempts in the ledger."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{folder}/results")
    good = spark.read.parquet(f"{folder}/ledger").where("status = 'success'").select(*keys, "attempt", "run")
    return rows.join(good, [*keys, "attempt", "run"], "left_semi")
