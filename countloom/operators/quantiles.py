"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import scan


def quantiles(rows: DataFrame, by: list[str], value: str, asked: dict[str, float]) -> DataFrame:
    """(by, a column for each name in ``asked``): quantiles by linear interpolation between the two nearest ranks; nulls are left out.

    Equal values are counted first, on the map side, so a value that many rows share is
    one row. Counts are added up along each group by a segmented scan, which spreads a
    group over all tasks; of each quantile the one or two values at its ranks are left.
    Groups without a value have no row.
    """
    known = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    upto = scan(known, by, ["_v"], sums={"_upto": "_c"})
    total = known.groupBy(*by).agg(F.sum("_c").alias("_n"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    # A row for each group.
    x = upto.join(total.select("_n", *[F.col(c).alias(f"_b_{c}") for c in by]), same)
    first = F.col("_upto") - F.col("_c")
    out = []
    for name, p in asked.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda rank: (first <= rank) & (rank < F.col("_upto"))
        share = at - low
        # Two ranks weigh 1 - share and share; where they are one, share is 0.
        weight = F.when(holds(low), 1 - share).otherwise(0.0) + F.when(holds(high), share).otherwise(0.0)
        out.append(F.sum(F.when(holds(low) | holds(high), F.col("_v") * weight)).alias(name))
    return x.groupBy(*by).agg(*out)
