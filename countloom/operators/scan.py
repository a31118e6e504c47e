"""Ranks, running sums and predecessors within segments, however long a segment is.

Rows are range-partitioned by (segment, key) and written once, as a range partitioning
samples anew each time it runs. Each range is then scanned on its own, and what the
ranges before it hold of a segment (a row for each range and segment) is added. So a
segment of all rows spreads over all tasks like many small ones, and the widest window
runs over one range, or over one segment's list of ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialise

MOST_RANGES = 1000


def ranges(df: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """The rows with ``_part``, the number of their range; written once."""
    parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES))
    return materialise(df.repartitionByRange(parts, *by, *key).withColumn("_part", F.spark_partition_id()), "ranges")


def scan(df: DataFrame, by: list[str], key: list[str], rank: str | None = None, sums: dict[str, str] | None = None, lags: dict[str, str] | None = None, size: str | None = None) -> DataFrame:
    """Adds to every row, within its segment ``by`` and in ``key`` order (keys are distinct within a segment):

    rank: its 0-based position; sums: new name to column, the sum up to and with the
    row; lags: new name to column, the value of the row before (null for the first);
    size: the segment's number of rows. Null segments and keys count as values, the
    least ones; nulls add nothing to a sum.
    """
    sums, lags = sums or {}, lags or {}
    ranged = ranges(df, by, key)
    held = ranged.groupBy("_part", *by).agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()], *[F.max_by(F.struct(F.col(c).alias("v")), F.struct(*key)).alias(f"_l_{o}") for o, c in lags.items()]
    )
    # A row for each range and segment: at most MOST_RANGES a segment.
    whole = W.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = held.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in by], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.sum("_n").over(whole).alias("_all"),
        *[F.sum(f"_s_{o}").over(before).alias(f"_s_{o}") for o in sums], *[F.last(f"_l_{o}").over(before).alias(f"_l_{o}") for o in lags],
    )
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    local = W.partitionBy("_part", *by).orderBy(*key)
    at = F.row_number().over(local)
    out = []
    if rank:
        out.append((F.col("_n") + at - 1).cast("bigint").alias(rank))
    for o, c in sums.items():
        own = F.sum(c).over(local.rowsBetween(W.unboundedPreceding, 0))
        out.append(F.when(own.isNull(), F.col(f"_s_{o}")).otherwise(own + F.coalesce(F.col(f"_s_{o}"), F.lit(0))).alias(o))
    for o, c in lags.items():
        out.append(F.when(at == 1, F.col(f"_l_{o}.v")).otherwise(F.lag(c).over(local)).alias(o))
    if size:
        out.append(F.col("_all").alias(size))
    return ranged.join(carry, same).select(*df.columns, *out)
