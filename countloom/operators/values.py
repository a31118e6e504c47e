"""Value model: how large is a positive cell?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import Q12, clamp_q, div, half_up, magnitude, odds_to_q, tail_group, value_context
from ..sources.matrix import CountMatrix, few
from .scan import scan
from .support import bits, fit_odds

BINS = 32
CONTEXTS = 7


def profiles(m: CountMatrix, k: int = 8) -> DataFrame:
    """(sample_id, g, n, a, tail_sum, grp, q) for every gene: positives, ones, sum of v - 1, tail-scale group, Q12 rate of ones."""
    v = F.col("v")
    per = m.counts.groupBy("sample_id", "g").agg(F.count("*").alias("n"), F.count(F.when(v == 1, 1)).alias("a"), F.sum(F.when(v > 1, v - 1).otherwise(0)).alias("tail_sum"))
    samples = m.spots.select("sample_id").distinct()
    all_ = m.genes.select("g").join(few(samples)).join(per, ["sample_id", "g"], "left").na.fill(0, ["n", "a", "tail_sum"])
    total = per.groupBy("sample_id").agg(F.sum("a").alias("sa"), F.sum("n").alias("sn"))
    one = (F.coalesce("sa", F.lit(0)) + F.lit(0.5)) / (F.coalesce("sn", F.lit(0)) + F.lit(1))
    q = clamp_q(half_up(F.lit(4096.0) * (F.col("a") + F.lit(0.5) + F.lit(16.0) * one) / (F.col("n") + F.lit(17))))
    joined = all_.join(total, "sample_id", "left")
    return joined.select("sample_id", "g", "n", "a", "tail_sum", tail_group(F.col("tail_sum"), F.col("n") - F.col("a"), k).alias("grp"), q.alias("q"))


def histograms(m: CountMatrix) -> DataFrame:
    """(sample_id, g, k, c): values above 1 by magnitude."""
    return m.counts.where("v > 1").groupBy("sample_id", "g", magnitude(F.col("v")).alias("k")).agg(F.count("*").alias("c"))


def grid(samples: DataFrame, **sizes: int) -> DataFrame:
    for name, n in sizes.items():
        samples = samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    return samples


def pooled(m: CountMatrix, prof: DataFrame, k: int = 8) -> DataFrame:
    """(sample_id, b, k, c, p): magnitudes by group, dense, with probabilities."""
    got = histograms(m).join(prof.select("sample_id", "g", F.col("grp").alias("b")), ["sample_id", "g"]).groupBy("sample_id", "b", "k").agg(F.sum("c").alias("c"))
    dense = grid(m.spots.select("sample_id").distinct(), b=k, k=BINS).join(got, ["sample_id", "b", "k"], "left").na.fill(0, ["c"])
    total = F.sum("c").over(W.partitionBy("sample_id", "b"))
    return dense.withColumn("p", (F.col("c") + F.lit(1 / 32)) / (total + F.lit(1)))


def quantise(dist: DataFrame, by: list[str]) -> DataFrame:
    """Adds freq: 32 integers of at least 1 that sum to 4096, by largest remainders (ties to the smaller k)."""
    raw = F.lit(4064.0) * F.col("p")
    first = dist.withColumn("_f", F.floor(raw).cast("bigint") + 1).withColumn("_r", raw - F.floor(raw))
    left = F.lit(Q12) - F.sum("_f").over(W.partitionBy(*by))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_r"), "k"))
    return first.withColumn("freq", (F.col("_f") + F.when(rank <= left, 1).otherwise(0)).cast("int")).drop("_f", "_r")


def base_tail(m: CountMatrix, prof: DataFrame, k: int = 8) -> DataFrame:
    return quantise(pooled(m, prof, k), ["sample_id", "b"]).select("sample_id", "b", "k", "freq")


def cumulative(freq: DataFrame, by: list[str]) -> DataFrame:
    """Adds start: what is below each symbol."""
    w = W.partitionBy(*by).orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    return freq.withColumn("start", F.coalesce(F.sum("freq").over(w), F.lit(0)).cast("int"))


def neighbour_sums(m: CountMatrix, graph: DataFrame) -> DataFrame:
    """(sample_id, i, g, v, s): positives with the sum of their neighbours' values."""
    c = m.counts.select("sample_id", F.col("i").alias("j"), "g", F.col("v").alias("s"))
    near = graph.select("sample_id", "i", "j").join(c, ["sample_id", "j"]).select("sample_id", "i", "g", F.lit(None).cast("bigint").alias("v"), "s")
    own = m.counts.select("sample_id", "i", "g", "v", F.lit(0).cast("bigint").alias("s"))
    return near.unionByName(own).groupBy("sample_id", "i", "g").agg(F.max("v").alias("v"), F.sum("s").alias("s")).where("v is not null")


def value_events(m: CountMatrix, cells: DataFrame | None, prof: DataFrame, width: int = 6) -> DataFrame:
    """(sample_id, i, g, v, b, c, q): positives with group, context and their gene's own Q12 rate. cells: support.neighbour_cells."""
    if cells is None:
        positive, c = m.counts, F.lit(7)
    else:
        positive, c = cells.where("v is not null"), value_context(F.col(f"s{width}"), F.col("i"), width)
    own = prof.select("sample_id", "g", F.col("grp").alias("b"), "q")
    return positive.join(own, ["sample_id", "g"]).select("sample_id", "i", "g", "v", "b", c.cast("int").alias("c"), "q")


def value_statistics(events: DataFrame) -> DataFrame:
    """(sample_id, b, c, q, n, y) of positives past the start."""
    return events.where("c < 7").groupBy("sample_id", "b", "c", "q").agg(F.count("*").alias("n"), F.count(F.when(F.col("v") == 1, 1)).alias("y"))


def tail_statistics(events: DataFrame) -> DataFrame:
    """(sample_id, b, c, k, t): magnitudes past the start."""
    return events.where("c < 7 and v > 1").groupBy("sample_id", "b", "c", magnitude(F.col("v")).alias("k")).agg(F.count("*").alias("t"))


def value_odds(events: DataFrame) -> DataFrame:
    return fit_odds(value_statistics(events), ["sample_id", "b", "c"])


def centres(prof: DataFrame, k: int = 8) -> DataFrame:
    """(sample_id, b, s): shared Q12 rate of ones by group, for every group."""
    per = prof.groupBy("sample_id", F.col("grp").alias("b")).agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    dense = grid(prof.select("sample_id").distinct(), b=k).join(per, ["sample_id", "b"], "left").na.fill(0, ["n", "a"])
    big = lambda x: F.lit(x).cast("bigint")
    s = clamp_q(div(big(Q12) * (big(2) * F.col("a") + 1) + F.col("n") + 1, big(2) * (F.col("n") + 1)))
    return dense.select("sample_id", "b", "n", "a", s.alias("s"))


def tail_tables(m: CountMatrix, prof: DataFrame, events: DataFrame, k: int = 8) -> DataFrame:
    """(sample_id, b, c, k, freq): conditional tables for contexts 0..6, the base for 7."""
    prior = pooled(m, prof, k).select("sample_id", "b", "k", "p")
    t = grid(m.spots.select("sample_id").distinct(), b=k, c=CONTEXTS, k=BINS).join(tail_statistics(events), ["sample_id", "b", "c", "k"], "left").na.fill(0, ["t"])
    total = F.sum("t").over(W.partitionBy("sample_id", "b", "c"))
    cond = t.join(prior.withColumnRenamed("p", "prior"), ["sample_id", "b", "k"]).withColumn("p", (F.col("t") + F.lit(16.0) * F.col("prior")) / (total + F.lit(16)))
    cond = quantise(cond, ["sample_id", "b", "c"]).select("sample_id", "b", "c", "k", "freq")
    base = base_tail(m, prof, k).select("sample_id", "b", F.lit(7).alias("c"), "k", "freq")
    return cond.unionByName(base)


def context_cdf(cent: DataFrame, odds: DataFrame, rate: str = "s") -> DataFrame:
    """(sample_id, b, c, q): Q12 rate of ones by group and context; 7 is the centre itself."""
    grid = cent.select("sample_id", "b", F.col(rate).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c"))
    joined = grid.join(odds, ["sample_id", "b", "c"], "left")
    q = F.when(F.col("c") == 7, F.col("_q")).otherwise(odds_to_q(F.col("_q"), F.coalesce("odds", F.lit(65536)).cast("bigint")))
    return joined.select("sample_id", "b", "c", q.cast("int").alias("q"))


def value_bits(prof: DataFrame, events: DataFrame, tails: DataFrame, odds: DataFrame, k: int = 8, shared: bool = True, exceptions: DataFrame | None = None) -> DataFrame:
    """(sample_id, g, singleton_bits, magnitude_bits, raw_bits).

    Odds are fitted against genes' own rates, cells are coded with their group's
    centre (``shared``) or with the gene's own rate; genes marked in ``exceptions``
    (sample_id, g, exception) keep their own.
    """
    if shared and exceptions is None:
        coded = events.drop("q").join(context_cdf(centres(prof, k), odds), ["sample_id", "b", "c"])
    else:
        if shared:
            centre = centres(prof, k).select("sample_id", "b", "s")
            events = events.join(centre, ["sample_id", "b"]).join(exceptions.select("sample_id", "g", "exception"), ["sample_id", "g"]).withColumn("q", F.when(F.col("exception"), F.col("q")).otherwise(F.col("s")))
        x = events.join(odds, ["sample_id", "b", "c"], "left")
        coded = x.withColumn("q", F.when(F.col("c") == 7, F.col("q")).otherwise(odds_to_q(F.col("q"), F.coalesce("odds", F.lit(65536)).cast("bigint"))))
    one = F.col("v") == 1
    single = F.when(one, bits(F.col("q"))).otherwise(bits(F.lit(Q12) - F.col("q")))
    coded = coded.withColumn("k", F.when(~one, magnitude(F.col("v")))).join(tails, ["sample_id", "b", "c", "k"], "left")
    return coded.groupBy("sample_id", "g").agg(F.sum(single).alias("singleton_bits"), F.sum(F.when(~one, bits(F.col("freq"))).otherwise(0.0)).alias("magnitude_bits"), F.sum(F.coalesce("k", F.lit(0))).cast("double").alias("raw_bits"))


def exception_bound(prof: DataFrame, cent: DataFrame, odds: DataFrame, k: int = 8) -> DataFrame:
    """(sample_id, g, bound, exception): most bits a gene may lose to its group's centre, over all contexts; above 12 it is an exception."""
    own = prof.select("sample_id", "g", "n", "a", F.col("grp").alias("b"), "q").join(cent.select("sample_id", "b", "s"), ["sample_id", "b"])
    return loss_bound(own, ["sample_id", "g"], odds)


def loss_bound(genes: DataFrame, by: list[str], odds: DataFrame) -> DataFrame:
    """(by, bound, exception) of genes(by, n, a, b, q, s): most bits lost by coding ``a`` ones in ``n`` at rate s instead of q, over all contexts of group b."""
    ctx = genes.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c")).join(odds, ["sample_id", "b", "c"], "left")
    r = F.coalesce("odds", F.lit(65536)).cast("bigint")
    at = lambda q: F.when(F.col("c") == 7, q).otherwise(odds_to_q(q, r)).cast("double")
    both = ctx.withColumn("old", at(F.col("q"))).withColumn("new", at(F.col("s")))
    per = both.groupBy(*by, "n", "a").agg(F.max(F.log2(F.col("old") / F.col("new"))).alias("up"), F.max(F.log2((F.lit(4096.0) - F.col("old")) / (F.lit(4096.0) - F.col("new")))).alias("down"), F.max((F.col("old") != F.col("new")).cast("int")).alias("differs"))
    u = F.when(F.col("differs") == 1, F.col("a") * F.col("up") + (F.col("n") - F.col("a")) * F.col("down") + F.lit(1e-10) * F.col("n")).otherwise(0.0)
    return per.select(*by, F.round(u, 6).alias("bound"), (u > 12).alias("exception"))


def mean_sort(m: CountMatrix) -> DataFrame:
    """(sample_id, g, place): genes by mean count, ties by number."""
    n = m.spots.groupBy("sample_id").agg(F.count("*").alias("n"))
    s = m.counts.groupBy("sample_id", "g").agg(F.sum("v").alias("s"))
    all_ = m.genes.select("g").join(few(n)).join(s, ["sample_id", "g"], "left").na.fill(0, ["s"])
    return scan(all_.select("sample_id", "s", "g"), ["sample_id"], ["s", "g"], rank="place").select("sample_id", "g", "place")


