"""Support model: is a cell positive?

Cells are never enumerated. A cell without positive neighbours and not positive
itself contributes to one statistic only, so those are counted as what is left of
rows times columns (the complement).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BUCKET_EDGES, Q12, bucket, clamp_q, half_up, odds_to_q
from ..sources.matrix import CountMatrix, few
from .blocks import context_counts, neighbour_cells  # noqa: F401


def rows_per_sample(m: CountMatrix) -> DataFrame:
    return m.spots.groupBy("sample_id").agg(F.count("*").alias("n"))


def gene_marginals(m: CountMatrix, edges: tuple[int, ...] = BUCKET_EDGES) -> DataFrame:
    """(sample_id, g, ones, q0, b) for every gene of every sample, absent ones too."""
    ones = m.counts.groupBy("sample_id", "g").agg(F.count("*").alias("ones"))
    all_ = m.genes.select("g").join(few(rows_per_sample(m))).join(ones, ["sample_id", "g"], "left").withColumn("ones", F.coalesce("ones", F.lit(0)))
    return all_.select("sample_id", "g", "n", "ones", _marginal().alias("q0")).withColumn("b", bucket(F.col("q0"), edges))


def _marginal() -> Column:
    return clamp_q(half_up((F.col("ones") + F.lit(0.5)) / (F.col("n") + F.lit(1.0)) * Q12))


def marginals_of(contexts: DataFrame) -> DataFrame:
    """(sample_id, g, n, ones, q0) of contexts_by_width, with 0 among the widths: what ``gene_marginals`` gives, without another pass over the cells."""
    return contexts.where("w = 0").select("sample_id", "g", "n", F.col("y").alias("ones")).withColumn("q0", _marginal())


def neighbour_support(m: CountMatrix, graph: DataFrame) -> DataFrame:
    """(sample_id, i, g, k): number of neighbours with a positive cell, where there is one."""
    c = m.counts.select("sample_id", F.col("i").alias("j"), "g")
    return graph.select("sample_id", "i", "j").join(c, ["sample_id", "j"]).groupBy("sample_id", "i", "g").agg(F.count("*").alias("k"))


def contexts_by_width(m: CountMatrix, graph: DataFrame, widths: tuple[int, ...] = (6,)) -> DataFrame:
    """(sample_id, w, g, k, n, y): cells past the first w rows by gene and positive neighbours among w, for all widths; k = 0 as the complement.

    A width of 0 has one row a gene: its cells, and how many are positive.
    """
    return context_counts(m, graph, widths, whole=True)


def sufficient_statistics(genes: DataFrame, late: DataFrame) -> DataFrame:
    """(sample_id, b, k, q, n, y), of gene_marginals and contexts of one width."""
    own = genes.select("sample_id", "g", "b", F.col("q0").alias("q"))
    return late.join(own, ["sample_id", "g"]).groupBy("sample_id", "b", "k", "q").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


def fit_odds(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, odds): 65536 times exp of the ridge log-odds shift of each group of (q, n, y), by 48 bisections.

    A group has at most one row for each of the 4095 values of q.
    """
    groups = stats.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("q").cast("int").alias("q"), F.col("n").cast("double").alias("n"), F.col("y").cast("double").alias("y")))).alias("s"))
    groups = groups.withColumn("s", F.transform("s", lambda r: F.struct(F.log(r.q / (F.lit(float(Q12)) - r.q)).alias("o"), r.n.alias("n"), r.y.alias("y"))))

    def slope(beta: Column) -> Column:
        return F.aggregate("s", F.lit(0.0), lambda t, r: t + (r.n / (F.lit(1.0) + F.exp(-(r.o + beta))) - r.y)) + beta

    def halve(x: Column, _: Column) -> Column:
        mid = (x.lo + x.hi) / 2
        up = slope(mid) > 0
        return F.struct(F.when(up, x.lo).otherwise(mid).alias("lo"), F.when(up, mid).otherwise(x.hi).alias("hi"))

    start = F.struct(F.lit(-8.0).alias("lo"), F.lit(8.0).alias("hi"))
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, halve, lambda x: (x.lo + x.hi) / 2)
    beta = F.when(slope(F.lit(-8.0)) >= 0, F.lit(-8.0)).when(slope(F.lit(8.0)) <= 0, F.lit(8.0)).otherwise(inner)
    return groups.select(*by, F.floor(F.exp(beta) * 65536 + F.lit(0.5)).cast("bigint").alias("odds"))


def support_odds(genes: DataFrame, late: DataFrame) -> DataFrame:
    """(sample_id, b, k, odds) of the contexts that occur; others keep 65536."""
    return fit_odds(sufficient_statistics(genes, late), ["sample_id", "b", "k"])


def all_odds(odds: DataFrame, samples: DataFrame, buckets: int = 8, width: int = 6) -> DataFrame:
    """Odds of every bucket and context."""
    grid = samples.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("b")).select("sample_id", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width).cast("bigint"))).alias("k"))
    return grid.join(odds, ["sample_id", "b", "k"], "left").withColumn("odds", F.coalesce("odds", F.lit(65536)).cast("bigint"))


def support_cdf(genes: DataFrame, odds: DataFrame, width: int = 6, buckets: int = 8) -> DataFrame:
    """(sample_id, g, k, q): probability of a positive cell by gene and positive neighbours."""
    full = all_odds(odds, genes.select("sample_id").distinct(), buckets, width)
    return genes.join(full, ["sample_id", "b"]).select("sample_id", "g", "k", odds_to_q(F.col("q0"), F.col("odds")).alias("q"))


def gene_context_table(m: CountMatrix, graph: DataFrame, late: DataFrame, width: int = 6) -> DataFrame:
    """(sample_id, g, ctx, seen, ones, q): contexts of neighbours present (n) and positive (k), ctx = n*7 + k, that occur."""
    late = late.select("sample_id", "g", (F.lit(width * 7) + F.col("k")).alias("ctx"), F.col("n").alias("seen"), F.col("y").alias("ones"))
    # The few rows at the start, with all their genes.
    early = m.spots.where(F.col("i") < width).select("sample_id", "i")
    cells = early.crossJoin(m.genes.select("g"))
    k = neighbour_support(m, graph.where(F.col("i") < width))
    own = m.counts.where(F.col("i") < width).select("sample_id", "i", "g", F.lit(1).alias("y"))
    ctx = F.least(F.col("i"), F.lit(width)) * 7 + F.coalesce("k", F.lit(0))
    start = cells.join(k, ["sample_id", "i", "g"], "left").join(own, ["sample_id", "i", "g"], "left").groupBy("sample_id", "g", ctx.alias("ctx")).agg(F.count("*").alias("seen"), F.sum(F.coalesce("y", F.lit(0))).alias("ones"))
    prior = (F.col("all") + F.lit(0.5)) / (F.col("n") + F.lit(1.0))
    genes = gene_marginals(m).select("sample_id", "g", "n", F.col("ones").alias("all"))
    p = (F.col("ones") + F.lit(8.0) * prior) / (F.col("seen") + F.lit(8.0))
    return late.unionByName(start).join(genes, ["sample_id", "g"]).select("sample_id", "g", "ctx", "seen", "ones", clamp_q(half_up(p * Q12)).alias("q"))


def bits(q: Column) -> Column:
    return F.lit(12.0) - F.log2(q)


def gene_context_bits(table: DataFrame) -> DataFrame:
    """(sample_id, bits): code length of the support by the genes' own context tables."""
    cost = F.col("ones") * bits(F.col("q")) + (F.col("seen") - F.col("ones")) * bits(F.lit(Q12) - F.col("q"))
    return table.groupBy("sample_id").agg(F.sum(cost).alias("bits"))


def support_bits(m: CountMatrix, genes: DataFrame, late: DataFrame | None, width: int = 6, buckets: int = 8) -> DataFrame:
    """(sample_id, g, bits): code length of a gene's whole support.

    Without contexts every cell costs by the gene's marginal alone. Rows at the start,
    whose neighbourhood is not full, cost by the marginal too.
    """
    cost = lambda q, y, n: y * bits(q) + (n - y) * bits(F.lit(Q12) - q)
    if late is None or width == 0:
        return genes.select("sample_id", "g", cost(F.col("q0"), F.col("ones"), F.col("n")).alias("bits"))
    full = all_odds(support_odds(genes, late), genes.select("sample_id").distinct(), buckets, width)
    coded = late.withColumnRenamed("n", "cells").join(genes.select("sample_id", "g", "q0", "b"), ["sample_id", "g"]).join(full, ["sample_id", "b", "k"])
    past = coded.select("sample_id", "g", cost(odds_to_q(F.col("q0"), F.col("odds")), F.col("y"), F.col("cells")).alias("bits"))
    first = m.counts.where(F.col("i") < width).groupBy("sample_id", "g").agg(F.count("*").alias("y"))
    start = genes.join(first, ["sample_id", "g"], "left").select("sample_id", "g", cost(F.col("q0"), F.coalesce("y", F.lit(0)), F.least(F.col("n"), F.lit(width))).alias("bits"))
    return past.unionByName(start).groupBy("sample_id", "g").agg(F.sum("bits").alias("bits"))
