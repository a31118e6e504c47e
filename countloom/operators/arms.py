"""Code lengths of many arms at once.

An arm differs from another in its buckets, in how many neighbours it looks at, or in whether
genes share rates. All of that is decided by a gene's rate and the context: so cells are read
once, combined by rate, width and context for all widths in one aggregation, and an arm is a
key from there on. Tables written do not depend on the number of arms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import Q12, bucket, magnitude, odds_to_q, value_context
from ..sources.matrix import CountMatrix
from ..sources.shared import materialise
from .support import bits, fit_odds
from .values import BINS, CONTEXTS, base_tail, centres, grid, pooled, quantise


def _each(structs: list[Column]) -> Column:
    return F.explode(F.array(*structs))


def _odds(odds: Column) -> Column:
    return F.coalesce(odds, F.lit(65536)).cast("bigint")


def support_arms(m: CountMatrix, marginals: DataFrame, contexts: DataFrame | None, arms: dict[str | int, tuple[tuple[int, ...], int]]) -> DataFrame:
    """(arm, sample_id, bits) of arms by name: edges of buckets, and neighbours (0: none, so contexts are not looked at).

    Genes of one rate cost alike in one context, so they are added up before there are arms.
    """
    widths = sorted({w for _, w in arms.values() if w})
    named = lambda df: df.withColumn("x", _each([F.struct(F.lit(a).alias("arm"), F.lit(w).cast("bigint").alias("of"), bucket(F.col("q0"), edges).alias("b")) for a, (edges, w) in arms.items()])).where("w = x.of").select("*", "x.arm", "x.b").drop("x")
    cost = lambda q, y, n: y * bits(q) + (n - y) * bits(F.lit(Q12) - q)
    added = [F.sum("n").alias("n"), F.sum("y").alias("y")]
    early = marginals.select("sample_id", F.lit(0).cast("bigint").alias("w"), "q0", "n", F.col("ones").alias("y")).groupBy("sample_id", "w", "q0").agg(*added)
    if widths:
        each = _each([F.lit(w).cast("bigint") for w in widths])
        first = m.counts.where(F.col("i") < max(widths)).select("sample_id", "g", "i", each.alias("w")).where("i < w").groupBy("sample_id", "w", "g").agg(F.count("*").alias("y"))
        ones = first.join(marginals.select("sample_id", "g", "q0"), ["sample_id", "g"]).select("sample_id", "w", "q0", F.lit(0).cast("bigint").alias("n"), "y")
        start = marginals.groupBy("sample_id", "q0", "n").agg(F.count("*").alias("genes")).select("sample_id", "q0", "n", "genes", each.alias("w")).select("sample_id", "w", "q0", (F.least("n", "w") * F.col("genes")).alias("n"), F.lit(0).cast("bigint").alias("y"))
        early = early.unionByName(ones.unionByName(start).groupBy("sample_id", "w", "q0").agg(*added))
    out = named(early).select("arm", "sample_id", cost(F.col("q0"), F.col("y"), F.col("n")).alias("bits"))
    if widths:
        late = materialise(contexts.where(F.col("w").isin(widths)).join(marginals.select("sample_id", "g", "q0"), ["sample_id", "g"]).groupBy("sample_id", "w", "q0", "k").agg(*added), "contexts")
        coded, key = named(late), ["sample_id", "arm", "b", "k"]
        odds = fit_odds(coded.select(*key, F.col("q0").alias("q"), "n", "y"), key)
        past = coded.join(odds, key, "left").select("arm", "sample_id", cost(odds_to_q(F.col("q0"), _odds(F.col("odds"))), F.col("y"), F.col("n")).alias("bits"))
        out = out.unionByName(past)
    return out.groupBy("arm", "sample_id").agg(F.sum("bits").alias("bits"))


def value_arms(m: CountMatrix, cells: DataFrame | None, prof: DataFrame, arms: dict[str | int, tuple[int, bool]], k: int = 32) -> DataFrame:
    """(arm, sample_id, bits) of arms by name: neighbours in the sum (0: none), and whether genes are coded with their group's rate."""
    widths = sorted({w for w, _ in arms.values()})
    own = {w: F.lit(7) if w == 0 else value_context(F.col(f"s{w}"), F.col("i"), w) for w in widths}
    positive = m.counts if cells is None else cells.where("v is not null")
    size = F.when(F.col("v") > 1, magnitude(F.col("v"))).otherwise(-1).cast("int")
    each = _each([F.struct(F.lit(w).alias("w"), c.cast("int").alias("c")) for w, c in own.items()])
    # Genes of one group and rate cost alike, so cells are added up by these and not by gene.
    graded = positive.join(prof.select("sample_id", "g", F.col("grp").alias("b"), "q"), ["sample_id", "g"])
    seen = materialise(graded.select("sample_id", "b", "q", size.alias("k"), each.alias("x")).groupBy("sample_id", "x.w", "b", "q", "x.c", "k").agg(F.count("*").alias("n")), "seen")
    past, key = seen.where("c < 7"), ["sample_id", "w", "b", "c"]
    odds = fit_odds(past.groupBy(*key, "q").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k") < 0, F.col("n")).otherwise(0)).alias("y")), key)
    counts = past.where("k >= 0").groupBy(*key, "k").agg(F.sum("n").alias("t"))
    samples = m.spots.select("sample_id").distinct().withColumn("w", _each([F.lit(w) for w in widths]))
    dense = grid(samples, b=k, c=CONTEXTS, k=BINS).join(counts, [*key, "k"], "left").na.fill(0, ["t"])
    prior = pooled(m, prof, k).select("sample_id", "b", "k", F.col("p").alias("prior"))
    total = F.sum("t").over(W.partitionBy(*key))
    tails = quantise(dense.join(prior, ["sample_id", "b", "k"]).withColumn("p", (F.col("t") + F.lit(16.0) * F.col("prior")) / (total + F.lit(16))), key).select(*key, "k", "freq")
    base = base_tail(m, prof, k).select("sample_id", _each([F.lit(w) for w in widths]).alias("w"), "b", F.lit(7).alias("c"), "k", "freq")
    named = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(w).alias("w"), F.lit(s).alias("shared")) for a, (w, s) in arms.items()])
    coded = seen.join(odds, key, "left").join(centres(prof, k).select("sample_id", "b", "s"), ["sample_id", "b"]).join(tails.unionByName(base), [*key, "k"], "left")
    coded = coded.withColumn("x", F.explode(F.filter(named, lambda a: a["w"] == F.col("w"))))
    rate = F.when(F.col("x.shared"), F.col("s")).otherwise(F.col("q"))
    p = F.when(F.col("c") == 7, rate).otherwise(odds_to_q(rate, _odds(F.col("odds"))))
    cost = F.when(F.col("k") < 0, bits(p)).otherwise(bits(F.lit(Q12) - p) + bits(F.col("freq")) + F.col("k"))
    return coded.groupBy("x.arm", "sample_id").agg(F.sum(F.col("n") * cost).alias("bits"))
