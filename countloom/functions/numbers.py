"""Sums and packed integers as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A limb stands for LIMB bits; sums of up to 2**38 of them fit a long.
LIMB = 24


def _mantissa(x: Column) -> Column:
    """struct(m, e) of a finite double that is not zero: |x| = m * 2**(e - 52), m of 53 bits. Every step is exact."""
    size = F.abs(x)
    # Logarithms of the smallest are taken of a multiple, so that powers of two stay in range.
    tiny = size < 2.0**-960
    y = F.when(tiny, size * 2.0**100).otherwise(size)
    power = lambda e: F.pow(F.lit(2.0), e)
    about = F.least(F.floor(F.log2(y)), F.lit(1023).cast("bigint"))
    first = y / power(about)
    e = about + F.when(first >= 2, 1).when(first < 1, -1).otherwise(0)
    return F.struct(F.floor(y / power(e) * 2.0**52).cast("bigint").alias("m"), (e - F.when(tiny, 100).otherwise(0)).cast("int").alias("e"))


def limbs(x: Column) -> Column:
    """A finite double as integers of a fixed grid: array of (k, v), x = sum of v * 2**(LIMB * k) exactly; empty for zero."""
    mask = (1 << LIMB) - 1

    def cut(p: Column) -> Column:
        bit = p["e"] - 52
        at = F.floor(bit / LIMB).cast("int")
        low = (bit - at * LIMB).cast("int")
        shift = lambda v: F.call_function("shiftleft", v, low)
        part = lambda i: F.shiftright(p["m"], LIMB * i).bitwiseAND(F.lit(mask).cast("bigint"))
        carry, out = F.lit(0).cast("bigint"), []
        for i in range(3):
            v = shift(part(i)) + carry
            out.append(v.bitwiseAND(F.lit(mask).cast("bigint")))
            carry = F.shiftright(v, LIMB)
        sign = F.when(x < 0, -1).otherwise(1).cast("bigint")
        return F.array(*[F.struct((at + i).alias("k"), (sign * v).alias("v")) for i, v in enumerate([*out, carry])])

    # transform over an array of one binds what is used several times.
    whole = F.flatten(F.transform(F.array(_mantissa(x)), cut))
    return F.when(x == 0, F.slice(whole, 1, 0)).otherwise(F.filter(whole, lambda p: p["v"] != 0))


def exact_sum(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """(by, name): the sum of each group's doubles as if added without rounding, then rounded once.

    Doubles become integers of a common grid (a superaccumulator), which are added by
    group and limb, on the map side first; a group has at most 90 limbs, put together at
    the end. So the result depends on no order or partitioning. Nulls are left out; a group
    of none but nulls is null; infinities and NaNs give what a plain sum gives.
    """
    fine = F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf"))
    odd = F.when(F.col("_x").isNotNull() & ~fine, F.col("_x"))
    none = F.array().cast("array<struct<k:int,v:bigint>>")
    cut = rows.select(*by, value.cast("double").alias("_x")).select(*by, odd.alias("_odd"), F.when(fine, F.lit(0)).alias("_some"), F.explode_outer(F.when(fine, limbs(F.col("_x"))).otherwise(none)).alias("p"))
    per = cut.groupBy(*by, F.col("p.k").alias("k")).agg(F.sum("p.v").alias("v"), F.sum("_odd").alias("_odd"), F.max("_some").alias("_some"))
    # At most 90 rows a group.
    whole = per.groupBy(*by).agg(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("k", "v"))).alias("p"), F.sum("_odd").alias("_odd"), F.max("_some").alias("_some"))
    total = F.when(F.col("_odd").isNotNull(), F.col("_odd")).when(F.col("_some").isNotNull(), _join(F.col("p.k"), F.col("p.v")))
    return whole.select(*by, total.alias(name))


@F.pandas_udf(T.DoubleType())
def _join(k: pd.Series, v: pd.Series) -> pd.Series:
    """Limbs to doubles; a quotient of integers rounds once."""

    def one(ks: np.ndarray, vs: np.ndarray) -> float:
        least = min((int(x) for x in ks), default=0)
        n = sum(int(b) << (LIMB * (int(a) - least)) for a, b in zip(ks, vs, strict=True))
        up, down = max(0, LIMB * least), max(0, -LIMB * least)
        try:
            return (n << up) / (1 << down)
        except OverflowError:
            return float("inf") if n > 0 else float("-inf")

    return pd.Series([None if a is None else one(a, b) for a, b in zip(k, v, strict=True)], dtype="float64")


def pack12(values: Column) -> Column:
    """Hex of 12-bit little-endian integers, padded with zero bits: two integers make three bytes."""
    at = lambda i: F.coalesce(F.get(values, i), F.lit(0).cast("bigint"))
    byte = lambda x: F.lpad(F.hex(x), 2, "0")

    def pair(j: Column) -> Column:
        a, b = at(2 * j), at(2 * j + 1)
        low = F.concat(byte(a.bitwiseAND(255)), byte(F.shiftright(a, 8).bitwiseOR(F.shiftleft(b.bitwiseAND(15), 4))))
        return F.concat(low, F.when(2 * j + 1 < F.size(values), byte(F.shiftright(b, 4))).otherwise(""))

    pairs = F.ceil(F.size(values) / 2).cast("int")
    return F.when(F.size(values) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), pair), ""))


def unpack12(packed: Column, n: Column) -> Column:
    """n integers out of the hex of pack12."""
    byte = lambda i: F.conv(F.substr(packed, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")

    def one(j: Column) -> Column:
        at = F.floor(j * 3 / 2).cast("int")
        even = byte(at) + F.shiftleft(byte(at + 1).bitwiseAND(15), 8)
        odd = F.shiftright(byte(at), 4) + F.shiftleft(byte(at + 1), 4)
        return F.when(j % 2 == 0, even).otherwise(odd)

    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one))
