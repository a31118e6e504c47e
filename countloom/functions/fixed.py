"""Fixed-point and binning functions.

Probabilities are Q12: integers 1..4095 over 4096. Everything that must be exact
stays in integers; doubles appear only where a definition has them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
Q12 = 4096
#: Left-closed edges of the support buckets (8 buckets).
BUCKET_EDGES = (1, 4, 16, 64, 256, 1024, 2048, 3072)
#: Edges for other numbers of buckets; 32 halves each of the 16.
BUCKET_FAMILY = {
    1: (1,),
    2: (1, 256),
    4: (1, 16, 256, 2048),
    8: BUCKET_EDGES,
    16: (1, 2, 4, 10, 16, 40, 64, 160, 256, 640, 1024, 1536, 2048, 2560, 3072, 3584),
}
#: Mean tail sizes that bound the eight tail-scale groups.
TAIL_BOUNDS = (1.0, 2.0, 4.0, 8.0, 16.0, 64.0, 256.0)
#: Upper ends of the neighbour-sum bins; bin 0 is the sum 0.
CONTEXT_ENDS = (12, 24, 48, 96, 384)
#: log2 of the bounds that other numbers of groups interpolate.
TAIL_KNOTS = (-1, 0, 1, 2, 3, 4, 6, 8, 10)
#: Rows that have no full neighbourhood use this context.
STARTUP = 7
U32 = 4294967295


def halved(edges: tuple[int, ...], top: int = Q12) -> tuple[int, ...]:
    """Edges with the middle of every bucket added, where it is a new one."""
    return tuple(sorted({*edges, *((a + b) // 2 for a, b in zip(edges, (*edges[1:], top), strict=True))}))


BUCKET_FAMILY[32] = halved(BUCKET_FAMILY[16])


def div(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative integers (the quotient of doubles would not be exact)."""
    return F.call_function("div", a, b)


def bucket(q: Column, edges: tuple[int, ...] = BUCKET_EDGES) -> Column:
    """Number of the left-closed bucket of a Q12 probability."""
    out = F.lit(0)
    for i, e in enumerate(edges):
        out = F.when(q >= e, F.lit(i)).otherwise(out) if i else out
    return out.cast("int")


def magnitude(v: Column) -> Column:
    """floor(log2(v - 1)) of a value above 1, by its binary digits."""
    return (F.length(F.bin(v - 1)) - 1).cast("int")


def remainder(v: Column) -> Column:
    """v - 1 - 2**magnitude(v): the raw bits below the leading one."""
    return v - 1 - F.call_function("shiftleft", F.lit(1).cast("bigint"), magnitude(v))


def from_magnitude(k: Column, rem: Column) -> Column:
    """Inverse of magnitude and remainder; null beyond 32 bits."""
    v = F.call_function("shiftleft", F.lit(1).cast("bigint"), k) + rem + 1
    return F.when(v <= U32, v)


def value_context(total: Column, row: Column, width: int = 6) -> Column:
    """Bin of a neighbour sum; rows without a full neighbourhood are apart."""
    out = F.when(row < width, F.lit(STARTUP)).when(total == 0, F.lit(0))
    for i, end in enumerate(CONTEXT_ENDS):
        out = out.when(total < end, F.lit(i + 1))
    return out.otherwise(F.lit(6)).cast("int")


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def clamp_q(x: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(Q12 - 1), x)).cast("int")


def odds_to_q(q: Column, odds: Column) -> Column:
    """Q12 probability after multiplying the odds of q by odds / 65536."""
    num = q.cast("bigint") * odds
    den = num + (F.lit(Q12).cast("bigint") - q) * 65536
    return clamp_q(div(F.lit(Q12).cast("bigint") * num + div(den, F.lit(2).cast("bigint")), den))


def tail_bounds(k: int) -> tuple[float, ...]:
    """Bounds of k groups; eight have their own."""
    if k == 8:
        return TAIL_BOUNDS
    out = []
    for j in range(1, k):
        at = j * 8 / k
        i = min(int(at), len(TAIL_KNOTS) - 2)
        out.append(2.0 ** (TAIL_KNOTS[i] + (at - i) * (TAIL_KNOTS[i + 1] - TAIL_KNOTS[i])))
    return tuple(out)


def tail_group(tail_sum: Column, n_tail: Column, k: int = 8) -> Column:
    """First group whose bound the mean tail does not pass; without a tail, group 0."""
    out = F.when(n_tail == 0, F.lit(0))
    for i, u in enumerate(tail_bounds(k)):
        out = out.when(tail_sum <= F.lit(u) * n_tail, F.lit(i))
    return out.otherwise(F.lit(k - 1)).cast("int")
