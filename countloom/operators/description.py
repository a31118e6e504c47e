"""Groups of genes by clustering, and what it costs to say them: the number of groups with the shortest description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import Q12, odds_to_q
from ..sources.matrix import few
from ..sources.shared import discard, materialise
from .scan import scan
from .support import bits
from .values import loss_bound

KS = (1, 2, 4, 8, 16, 32)


def _pooled(n: Column, a: Column) -> Column:
    """Rate of ``a`` in ``n`` in 12 bits, rounded half up."""
    big = lambda x: F.lit(x).cast("bigint")
    whole = F.floor((big(Q12) * (big(2) * a + 1) + n + 1) / (big(2) * (n + 1)))
    return F.greatest(F.lit(1), F.least(F.lit(Q12 - 1), whole)).cast("int")


def cluster_samples(genes: DataFrame, ks: tuple[int, ...] = KS, rounds: int = 20) -> DataFrame:
    """(sample_id, k, g, label, centre): Lloyd's iterations over Bernoulli costs of (n, a) by sample and gene, for each k.

    Labels start by rank of (a + 1/2) / (n + 1); genes without events have label 0. A round is one
    aggregation over genes to centres, a row for each sample and k, which is written and
    sent back to the genes: so nothing comes to the driver, and no plan grows.
    """
    rate = (F.col("a") + 0.5) / (F.col("n") + 1)
    ranked = scan(genes.select("sample_id", "g", "n", "a", rate.alias("_rate")), ["sample_id"], ["_rate", "g"], rank="_rank", size="_total")
    each = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    start = F.floor(F.col("_rank") * F.col("k") / F.col("_total"))
    labelled = materialise(each.select("sample_id", "k", "g", "n", "a", F.when(F.col("n") == 0, 0).otherwise(start).cast("int").alias("label")), "labelled")
    table = labelled.select("sample_id", "k").distinct().withColumn("centres", F.array_repeat(F.lit(2048), F.col("k")))
    current, before = labelled, None
    for step in range(rounds + 1):
        sums = current.groupBy("sample_id", "k", "label").agg(F.sum("n").cast("bigint").alias("n"), F.sum("a").cast("bigint").alias("a")).where("n > 0")
        found = sums.groupBy("sample_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("label", _pooled(F.col("n"), F.col("a"))))).alias("found"))
        # A group without events keeps its centre.
        kept = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("found", i), c))
        table = materialise(table.join(found, ["sample_id", "k"], "left").select("sample_id", "k", F.when(F.col("found").isNull(), F.col("centres")).otherwise(kept).alias("centres")), "centres")
        if step < rounds:
            # What this round's labels were read from is needed no more.
            discard(before)
            before = table
            logs = F.transform("centres", lambda c: F.struct(F.log(c / F.lit(float(Q12))).alias("one"), F.log1p(-c / F.lit(float(Q12))).alias("more")))
            # The cheapest centre by gene, ties to the smaller label.
            costs = F.transform("logs", lambda x, i: F.struct((-F.col("a") * x["one"] - (F.col("n") - F.col("a")) * x["more"]).alias("cost"), i.alias("i")))
            placed = labelled.drop("label").join(few(table.select("sample_id", "k", logs.alias("logs"))), ["sample_id", "k"])
            current = placed.select("sample_id", "k", "g", "n", "a", F.when(F.col("n") == 0, 0).otherwise(F.array_min(costs)["i"]).cast("int").alias("label"))
    return current.join(few(table), ["sample_id", "k"]).select("sample_id", "k", "g", "label", F.element_at("centres", F.col("label") + 1).alias("centre"))


def cluster_rates(genes: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """(g, label, centre) of the genes of one sample."""
    return cluster_samples(genes.withColumn("sample_id", F.lit("")), (k,), rounds).select("g", "label", "centre")


def description_lengths(prof: DataFrame, labels: DataFrame, events: DataFrame, odds: DataFrame) -> DataFrame:
    """(sample_id, k, exceptions, n_exceptions, model_bits, singleton_bits, bytes, selected): what each arm's description costs.

    An arm is a number of groups k, and whether genes that would lose more than 12 bits to their
    group's centre keep their own rate (exceptions). Paid are a label a gene, 12 bits a
    centre, with exceptions one bit a gene and 12 an exception, and the code length of
    which positives are ones, by gene, context and odds of the value groups. All arms go
    through one aggregation of the events by gene and context. selected: the fewest bytes,
    ties to the fewer groups, then to no exceptions.
    """
    arm = ["sample_id", "k"]
    genes = prof.select("sample_id", "g", "n", "a", F.col("grp").alias("b"), "q").join(labels.select(*arm, "g", F.col("centre").alias("s")), ["sample_id", "g"])
    bound = loss_bound(genes, [*arm, "g"], odds).select(*arm, "g", "exception")
    each = genes.join(bound, [*arm, "g"]).withColumn("exceptions", F.explode(F.array(F.lit(False), F.lit(True))))
    each = materialise(each.withColumn("kept", F.col("exceptions") & F.col("exception")).withColumn("q", F.when(F.col("kept"), F.col("q")).otherwise(F.col("s"))).select(*arm, "exceptions", "g", "b", "q", "kept"), "arms")
    seen = events.groupBy("sample_id", "g", "c").agg(F.count(F.when(F.col("v") == 1, 1)).alias("ones"), F.count(F.when(F.col("v") != 1, 1)).alias("more"))
    x = each.join(seen, ["sample_id", "g"]).join(odds, ["sample_id", "b", "c"], "left")
    p = F.when(F.col("c") == 7, F.col("q")).otherwise(odds_to_q(F.col("q"), F.coalesce("odds", F.lit(65536)).cast("bigint")))
    key = [*arm, "exceptions"]
    coded = x.groupBy(*key).agg(F.sum(F.col("ones") * bits(p) + F.col("more") * bits(F.lit(Q12) - p)).alias("singleton_bits"))
    per = each.groupBy(*key).agg(F.count("*").alias("genes"), F.count(F.when(F.col("kept"), 1)).alias("n_exceptions"))
    model = F.col("genes") * F.log2("k") + 12.0 * F.col("k") + F.when(F.col("exceptions"), F.col("genes") + 12.0 * F.col("n_exceptions")).otherwise(0.0)
    out = per.join(coded, key, "left").select(*key, "n_exceptions", F.round(model, 6).alias("model_bits"), F.round(F.coalesce("singleton_bits", F.lit(0.0)), 6).alias("singleton_bits"))
    out = materialise(out.withColumn("bytes", F.ceil(F.round(F.col("model_bits") + F.col("singleton_bits"), 5) / 8)), "lengths")
    best = out.groupBy("sample_id").agg(F.min(F.struct("bytes", "k", "exceptions")).alias("best"))
    return out.join(few(best), "sample_id").withColumn("selected", F.struct("bytes", "k", "exceptions") == F.col("best")).drop("best")
