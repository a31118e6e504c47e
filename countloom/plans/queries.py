"""Registered queries over the driver's tables. Results have long integers, and doubles rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import coder, cohort, description, graph, layout, support, values
from ..operators.study import Study
from ..sources import archive, matrix
from ..sources.matrix import CountMatrix, from_tables
from ..sources.shared import drop_unread
from . import audits, oracles, storage
from .inputs import Query, members, people, results, tidy

def _matrix(f: Callable[[CountMatrix], DataFrame], measure: str = "quantity") -> Query:
    return lambda spark, d: tidy(f(from_tables(spark, d, measure)))


def _graph(f: Callable[[CountMatrix, DataFrame], DataFrame], measure: str = "quantity", width: int = 6) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = from_tables(spark, d, measure)
        return tidy(f(m, graph.causal_neighbours(m.spots, width)))

    return run


def _study(f: Callable[[Study], DataFrame], measure: str = "quantity", **sizes) -> Query:
    return lambda spark, d: tidy(f(Study(from_tables(spark, d, measure), **sizes)))


def _results(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: tidy(f(results(spark, d)))


def _by_sample(bits: DataFrame) -> DataFrame:
    return bits.groupBy("sample_id").agg(F.sum("bits").alias("bits"))


def _arms_of(arms: dict, name: str) -> DataFrame:
    """One table of tables by arm."""
    out = None
    for key, x in arms.items():
        y = x.withColumn(name, F.lit(key))
        out = y if out is None else out.unionByName(y)
    return out


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Code length by sample: 8 support buckets, 32 value groups."""
    return _study(lambda st: st.total_bits(32))(spark, d)


def _totals(support_: DataFrame, value: DataFrame, on: list[str]) -> DataFrame:
    """Adds up (arm, sample_id, bits) of both models."""
    x = support_.withColumnRenamed("bits", "support_bits").join(value.withColumnRenamed("bits", "value_bits"), on)
    return x.withColumn("total_bits", F.col("support_bits") + F.col("value_bits"))


def context_arms(st: Study) -> DataFrame:
    """Support and value contexts with and without neighbours."""
    s = st.support_arms({f"S{n}": (fixed.BUCKET_EDGES, 6 * n) for n in (0, 1)}).withColumnRenamed("arm", "s")
    v = st.value_arms(32, {f"V{n}": (6 * n, True) for n in (0, 1)}).withColumnRenamed("arm", "v")
    return _totals(s, v, ["sample_id"]).select(F.concat("s", "v").alias("arm"), "sample_id", "support_bits", "value_bits", "total_bits")


def bucket_arms(st: Study) -> DataFrame:
    """Support code length with 1, 2, 4, 8, 16 and 32 buckets."""
    return st.support_arms({n: (edges, 6) for n, edges in fixed.BUCKET_FAMILY.items()}).withColumnRenamed("arm", "buckets")


def joint_arms(st: Study) -> DataFrame:
    """Support code length with 16 and 32 buckets and 4, 6 and 8 neighbours."""
    return st.support_arms({f"B{n}_M{w}": (fixed.BUCKET_FAMILY[n], w) for n in (16, 32) for w in (4, 6, 8)})


def width_arms(st: Study) -> DataFrame:
    """Support code length with 0 to 16 neighbours."""
    return st.support_arms({n: (fixed.BUCKET_EDGES, n) for n in (0, 2, 4, 6, 8, 12, 16)}).withColumnRenamed("arm", "neighbours")


def module_arms(st: Study) -> DataFrame:
    """The full model and four without a part of it."""
    s = st.support_arms({a: (fixed.BUCKET_EDGES, w) for a, w in {"full": 6, "no_support": 0, "no_value": 6, "no_spatial": 0, "no_sharing": 6}.items()})
    v = st.value_arms(32, {"full": (6, True), "no_support": (6, True), "no_spatial": (0, True), "no_sharing": (6, False)})
    raw = st.m.counts.groupBy("sample_id").agg((F.count("*") * 32.0).alias("bits")).select(F.lit("no_value").alias("arm"), "sample_id", "bits")
    return _totals(s, v.unionByName(raw), ["arm", "sample_id"])


def value_width_arms(st: Study) -> DataFrame:
    """Value code length with 0 to 12 neighbours in the sum; support is left alone.

    A row counts as started once it has that many neighbours, so that narrower sums
    are not charged for a longer start.
    """
    return st.value_arms(32, {n: (n, True) for n in (0, 2, 4, 6, 8, 12)}).withColumnRenamed("arm", "neighbours")


def described(st: Study, rounds: int = 20) -> DataFrame:
    """Description length by number of groups and with or without exceptions; without rounds, groups are ranks of rates."""
    labels = description.cluster_samples(st.profiles().select("sample_id", "g", "n", "a"), rounds=rounds)
    return description.description_lengths(st.profiles(), labels, st.events(), st.value_odds())


def _ordered(m: CountMatrix, order: DataFrame) -> CountMatrix:
    """Rows in another order: (sample_id, place, i)."""
    move = lambda df: df.join(order, ["sample_id", "i"]).drop("i").withColumnRenamed("place", "i")
    return CountMatrix(move(m.counts), move(m.spots), m.genes)


def _order_arms(m: CountMatrix, orders: dict[str, DataFrame | None]) -> DataFrame:
    """Support code length by order of rows; an order that is not the given one costs 32 bits a row."""
    arms = {}
    for name, order in orders.items():
        st = Study(m if order is None else _ordered(m, order))
        paid = F.lit(0 if order is None else 32)
        arms[name] = _by_sample(st.support_bits()).join(support.rows_per_sample(st.m), "sample_id").select("sample_id", "bits", (F.col("n") * paid).alias("order_bits"))
    return _arms_of(arms, "arm")


def order_arms(spark: SparkSession, d: str) -> DataFrame:
    """The given row order and the canonical one."""
    m = from_tables(spark, d)
    return tidy(_order_arms(m, {"original": None, "canonical": layout.canonical_order(m)}))


def seeded_order_arms(spark: SparkSession, d: str) -> DataFrame:
    """Row orders permuted by NumPy's generator, seeds parsed out of the arms' names."""
    m = from_tables(spark, d)
    return tidy(_order_arms(m, {a: layout.permuted_order(m.spots, cohort.seed_of(a)) for a in ("RANDOM_SEED_11", "RANDOM_SEED_23", "RANDOM_SEED_37")}))


def _gene_context_bits(st: Study) -> DataFrame:
    return support.gene_context_bits(support.gene_context_table(st.m, st.graph, st.late()))


def gene_context_arms(spark: SparkSession, d: str) -> DataFrame:
    """Support code length of per-gene context tables: no neighbours, previous rows, nearest rows."""
    st = Study(from_tables(spark, d))
    return tidy(_arms_of({"S0_gene": _by_sample(st.support_bits(width=0)), "S1_prefix": _gene_context_bits(st.of_graph(graph.previous_rows(st.m.spots))), "S2_spatial": _gene_context_bits(st)}, "arm"))


def shared_graph_arms(spark: SparkSession, d: str) -> DataFrame:
    """Support code length of the shared model by kind of graph: previous rows, nearest rows."""
    st = Study(from_tables(spark, d))
    return tidy(_arms_of({"gene": _by_sample(st.support_bits(width=0)), "P1_shared_prefix": _by_sample(st.of_graph(graph.previous_rows(st.m.spots)).support_bits()), "P2_shared_spatial": _by_sample(st.support_bits())}, "arm"))


def shuffled_graph_arms(spark: SparkSession, d: str) -> DataFrame:
    """Controls: both models on graphs of permuted coordinates."""
    st = Study(from_tables(spark, d))
    arms = {}
    for seed in (11, 29, 47):
        x = st.of_graph(graph.causal_neighbours(graph.shuffled_coordinates(st.m.spots, seed)))
        arms[f"S2_shuffle_{seed}"] = _gene_context_bits(x)
        if seed == 11:
            arms["P2_shared_shuffle11"] = _by_sample(x.support_bits())
    return tidy(_arms_of(arms, "arm"))


def shuffled_neighbours(m: CountMatrix) -> DataFrame:
    """Control: graphs of permuted coordinates (NumPy's generator, seeds 11, 29 and 47)."""
    out = None
    for seed in (11, 29, 47):
        x = graph.causal_neighbours(graph.shuffled_coordinates(m.spots, seed)).select(F.lit(seed).alias("seed"), "sample_id", "i", "r", "j")
        out = x if out is None else out.unionByName(x)
    return out


def shuffled_groups(spark: SparkSession, d: str) -> DataFrame:
    """Control: value code length with genes' groups as they are and permuted (NumPy's generator, seed 11), tables made anew."""
    st = Study(from_tables(spark, d))
    prof = st.profiles(32)
    order = layout.permutation(st.m.genes.select(F.lit("").alias("sample_id"), F.col("g").alias("i")), 11).select(F.col("place").alias("g"), F.col("i").alias("source"))
    groups = prof.select("sample_id", F.col("g").alias("source"), F.col("grp").alias("moved"))
    mixed = prof.join(order, "g").join(groups, ["sample_id", "source"]).select("sample_id", "g", "n", "a", "tail_sum", F.col("moved").alias("grp"), "q")
    arms = [x.value_arms(32, {name: (6, True)}) for name, x in (("K32", st), ("K32_shuffled", st.of_profiles(32, mixed)))]
    return tidy(arms[0].unionByName(arms[1]).select("sample_id", "bits", "arm"))


def _pair(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: tidy(f(members(spark, d, "a"), members(spark, d, "b")))


BASE = "L1"


def _arms(r: DataFrame) -> DataFrame:
    return r.select("arm").distinct()


def _odd_entries(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    v = F.when(F.col("l_linenumber") == 1, F.col("l_quantity").cast("double") + 0.5).when(F.col("l_linenumber") == 2, -F.col("l_quantity").cast("double")).when(F.col("l_linenumber") == 3, F.lit(4294967296.0)).otherwise(F.col("l_quantity").cast("double"))
    return line.select(F.col("l_linenumber").alias("i"), v.alias("v"))


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = members(spark, d, "a")
    cats = spark.createDataFrame([("m1", "payload"), ("m2", "payload"), ("m3", "model"), ("m4", "graph"), ("m5", "identity"), ("m6", "manifest")], "member string, category string")
    totals = m.groupBy("archive_id").agg((F.sum("bytes") + F.count("*") * 3).alias("total"))
    return cohort.ledger(m, cats, totals), totals


QUERIES: dict[str, Query] = {
    # sources, canonical form and validation
    "io5_compressed_to_all_cells": lambda s, d: tidy(layout.round_trip_compressed(from_tables(s, d))),
    "io8_compressed_rows": _matrix(lambda m: layout.compressed_text(matrix.to_compressed(m.counts, m.spots))),
    "io2_label_decode": lambda s, d: tidy(layout.decode_labels(s, d)),
    "io3_axis_lengths": _matrix(layout.axis_lengths),
    "io19_content_addressed": lambda s, d: tidy(layout.content_addressed(members(s, d, "a").unionByName(members(s, d, "b")))),
    "p1_invalid_values": lambda s, d: tidy(matrix.invalid_entries(_odd_entries(s, d)).groupBy("i").agg(F.count("*").alias("n"), F.sum("v").alias("total"))),
    "p2_budget": _matrix(matrix.budget),
    "p3_pointer_faults": lambda s, d: tidy(matrix.pointer_faults(layout.broken_pointers(from_tables(s, d)))),
    "p5_graph_faults": lambda s, d: tidy(graph.graph_faults(graph.causal_neighbours((m := from_tables(s, d)).spots).where("r <> 2 or i % 9 <> 0"), m.spots).select("sample_id", "i")),
    "p7_exact_compare": lambda s, d: tidy(layout.compare(from_tables(s, d, "quantity").counts, from_tables(s, d, "tens").counts)),
    "p9_safe_names": lambda s, d: tidy(layout.names(s, d).withColumn("safe", cohort.safe_name(F.col("name")))),
    "p10_release_gate": lambda s, d: tidy(cohort.gate(layout.doors(s, d))),
    "p12_failure_outcomes": lambda s, d: tidy(layout.messages(s, d).withColumn("outcome", cohort.outcome(F.col("status"), F.col("method"), F.col("message"))).groupBy("outcome").agg(F.count("*").alias("n"))),
    "canonical_counts": _matrix(lambda m: m.counts, "tens"),
    # graphs
    "j1_causal_neighbours": _graph(lambda m, g: g.select("sample_id", "i", "r", "j")),
    "j2_wide_neighbours": _graph(lambda m, g: g.select("sample_id", "i", "r", "j"), width=12),
    "j3_previous_rows": _matrix(lambda m: graph.previous_rows(m.spots)),
    "j4_shuffled_neighbours": _matrix(shuffled_neighbours),
    "a25_edge_statistics": _graph(lambda m, g: graph.edge_statistics(g)),
    "a25_neighbour_histogram": _graph(lambda m, g: graph.neighbour_histogram(g, m.spots)),
    # support
    "j5_neighbour_support": _graph(support.neighbour_support, "count"),
    "a1_gene_marginals": _matrix(lambda m: support.gene_marginals(m).select("sample_id", "g", "ones", "q0", "b"), "count"),
    "a2_gene_contexts": _study(lambda st: support.gene_context_table(st.m, st.graph, st.late()), "count", once=True),
    "a8_sufficient_statistics": _study(lambda st: support.sufficient_statistics(st.marginals(), st.late()), "count", once=True),
    "m1_support_odds": _study(lambda st: st.support_odds(), "count", once=True),
    "m2_support_cdf": _study(lambda st: support.support_cdf(st.marginals(), st.support_odds()), "count", once=True),
    "m7_support_bits": _study(lambda st: _by_sample(st.support_bits()), "count", once=True),
    # values
    "a3_value_profiles": _matrix(lambda m: values.profiles(m)),
    "a3_value_histograms": _matrix(values.histograms),
    "a6_groups_32": _matrix(lambda m: values.profiles(m, 32).select("sample_id", "g", "grp")),
    "a7_pooled_tails": _matrix(lambda m: values.pooled(m, values.profiles(m))),
    "w2_quantised_tails": _matrix(lambda m: values.base_tail(m, values.profiles(m))),
    "w3_cumulative": _matrix(lambda m: values.cumulative(values.base_tail(m, values.profiles(m)), ["sample_id", "b"])),
    "j6_neighbour_sums": _graph(values.neighbour_sums),
    "j7_cell_gene_lookup": _study(lambda st: st.events(), once=True),
    "a9_value_statistics": _study(lambda st: values.value_statistics(st.events()), once=True),
    "a9_tail_statistics": _study(lambda st: values.tail_statistics(st.events()), once=True),
    "m1_value_odds": _study(lambda st: st.value_odds(), once=True),
    "a10_centres": _matrix(lambda m: values.centres(values.profiles(m))),
    "m4_tail_tables": _study(lambda st: st.tails(), once=True),
    "m2_value_cdf": _study(lambda st: values.context_cdf(values.centres(st.profiles()), st.value_odds()), once=True),
    "a11_exception_bound": _study(lambda st: st.exceptions(), once=True),
    "m7_value_bits": _study(lambda st: st.value_bits().groupBy("sample_id").agg(F.sum("singleton_bits").alias("singleton_bits"), F.sum("magnitude_bits").alias("magnitude_bits"), F.sum("raw_bits").alias("raw_bits")), once=True),
    "a23_group_diagnostics": _matrix(lambda m: values.profiles(m, 32).groupBy("sample_id", "grp").agg(F.count("*").alias("genes"), F.sum("n").alias("events"))),
    "a24_sample_profile": _matrix(layout.sample_profile),
    "m10_code_length_k32": flagship,
    "m15_context_arms": _study(context_arms),
    "m16_bucket_arms": _study(bucket_arms, once=True),
    "m16_joint_arms": _study(joint_arms, width=8, widths=(4, 6)),
    "j2_width_arms": _study(width_arms, width=16, widths=(2, 4, 6, 8, 12)),
    "m19_module_arms": _study(module_arms),
    "m13_gene_context_arms": gene_context_arms,
    "m14_shared_graph_arms": shared_graph_arms,
    "m13_m14_shuffled_graph_arms": shuffled_graph_arms,
    "m17_value_width_arms": _study(value_width_arms, width=12, widths=(2, 4, 6, 8)),
    "m18_order_arms": order_arms,
    "m18_seeded_order_arms": seeded_order_arms,
    "m20_shuffled_groups": shuffled_groups,
    "m12_exceptions": _study(lambda st: st.exceptions().groupBy("sample_id").agg(F.count(F.when(F.col("exception"), 1)).alias("exceptions"), F.count("*").alias("genes")), once=True),
    "m12_code_length": _study(lambda st: st.total_bits(8, exceptions=True)),
    "m6_rate_clusters": lambda s, d: tidy(description.cluster_samples(values.profiles(from_tables(s, d)).select("sample_id", "g", "n", "a"))),
    "m6_description_length": _study(described),
    "m6_description_of_ranks": _study(lambda st: described(st, 0)),
    "m8_m9_entropy_round_trip": lambda s, d: tidy(coder.round_trip(from_tables(s, d))),
    "io9_archive_round_trip": lambda s, d: tidy(archive.round_trip(from_tables(s, d))),
    "c8_comparators": lambda s, d: tidy(coder.comparators(from_tables(s, d))),
    # layout and order
    "w4_row_pointers": _matrix(lambda m: matrix.row_pointers(m.counts, m.spots)),
    "w5_gaps": _matrix(lambda m: layout.gaps(m.counts)),
    "w5_gaps_decoded": _matrix(lambda m: layout.ungap(layout.gaps(m.counts))),
    "w6_rank_labels": _matrix(lambda m: layout.rank_labels(values.profiles(m), 8)),
    "w7_canonical_order": _matrix(layout.canonical_order),
    "w8_inverse_order": _matrix(lambda m: layout.inverse_order(layout.canonical_order(m))),
    "w9_mean_sort": _matrix(values.mean_sort),
    "c11_value_runs": _matrix(lambda m: layout.value_runs(m.counts), "count"),
    "a22_digest": lambda s, d: tidy(coder.digest(from_tables(s, d))),
    # cohorts
    "j9_coverage": lambda s, d: tidy(cohort.coverage((r := results(s, d)).select("sample_id").distinct(), _arms(r), r.where("n_lines % 3 <> 0"))),
    "a20_status_counts": lambda s, d: tidy(cohort.status_counts(cohort.coverage((r := results(s, d)).select("sample_id").distinct(), _arms(r), r.where("n_lines % 3 <> 0")))),
    "j10_pairs": _results(lambda r: cohort.pairs(r, BASE)),
    "a15_paired_summary": _results(lambda r: cohort.paired_summary(r, BASE)),
    "a16_stratified": _results(lambda r: cohort.stratified(r, BASE)),
    "a13_pooled_summary": _results(cohort.pooled_summary),
    "a14_complete_summary": _results(cohort.complete_summary),
    "a17_module_summary": _results(lambda r: cohort.module_summary(r, BASE)),
    "j11_pivoted": _results(lambda r: cohort.pivoted(r, ["L1", "L2", "L3", "L4"])),
    "a18_factorial": _results(lambda r: cohort.factorial(r, "L1", "L2", "L3", "L4")),
    "a19_weighted_ratios": _results(cohort.weighted_ratios),
    "a21_uniqueness": _results(lambda r: r.agg(F.count("*").alias("rows"), F.countDistinct("sample_id", "arm").alias("keys"), (F.count("*") == F.countDistinct("sample_id", "arm")).alias("unique"))),
    "c1_quota": lambda s, d: tidy(cohort.quota(people(s, d), 60, ["species", "organ"], F.sha2(F.concat(F.lit("v1:"), F.col("id")), 256)).select("id", "species", "organ")),
    "w11_hash_ranked": lambda s, d: tidy(cohort.hash_ranked(people(s, d), "v1:", 50).select("id", "digest")),
    "c2_queue": lambda s, d: tidy(cohort.queue(people(s, d), _arms(results(s, d)), "passed").groupBy("arm", "state").agg(F.count("*").alias("n"))),
    "c3_reconcile": lambda s, d: tidy(cohort.reconcile(people(s, d), people(s, d).where("organ % 3 = 0").select("id", (F.col("balance") > 0).alias("ready"), (F.col("organ") % 2 == 0).alias("seen")))),
    "j13_manifest_faults": _pair(cohort.manifest_faults),
    "j14_member_difference": _pair(cohort.member_difference),
    "j15_pin_bridge": lambda s, d: tidy(layout.pin_bridge(members(s, d, "a"), members(s, d, "b"))),
    "j16_outstanding": lambda s, d: tidy(cohort.outstanding((r := results(s, d)).select("sample_id", "arm"), cohort.good(r))),
    "u2_member_sets": _pair(layout.member_sets),
    "c5_ledger": lambda s, d: tidy(_ledger(s, d)[0]),
    "c7_fees": _results(lambda r: cohort.good(r).groupBy("arm").agg(F.sum("total_bytes").alias("total"), (F.sum("model") + F.sum("framing")).alias("fees"))),
    "u1_union": _results(lambda r: r.where("arm = 'L1'").select("sample_id", "arm", "total_bytes").unionByName(r.where("arm = 'L2'").select("sample_id", "arm", "n_lines"), allowMissingColumns=True)),
    "c22_conservation": lambda s, d: tidy(cohort.conservation_faults((x := _ledger(s, d))[0].where("not (category = 'graph' and archive_id % 6 = 0)"), x[1])),
    "c12_coverage_audit": _results(lambda r: cohort.coverage_audit(r.where("n_lines % 3 <> 0"), 7)),
    "c15_recompute_audit": _results(lambda r: cohort.recompute_audit(r.withColumn("bpc", F.col("total_bytes") * 8 / F.col("n_counts") + F.when(F.col("n_lines") % 5 == 0, 1e-6).otherwise(0.0)))),
    "c19_near_minimum": _results(lambda r: cohort.near_minimum(cohort.pooled_summary(r).select("arm", "total", "n"), "total", "arm", 0.02)),
    "w12_argmin": _results(lambda r: cohort.good(r).groupBy("sample_id").agg(F.min_by("arm", F.struct("total_bytes", "n_counts", "arm")).alias("arm"))),
    "c20_three_way": _results(lambda r: cohort.pairs(r, BASE).groupBy("arm").agg(F.min("delta").alias("lo"), F.max("delta").alias("hi")).select("arm", cohort.three_way(F.col("lo"), F.col("hi")).alias("verdict"))),
    "c21_effective": _results(lambda r: cohort.effective(r, r.withColumn("status", F.lit("success")).where("n_lines % 2 = 0")).select("sample_id", "arm", "status", "origin")),
    "c17_distributions": _results(lambda r: cohort.distributions(r, ["status", "platform", "species", "organ"])),
    "c18_legacy": _results(lambda r: cohort.legacy(r.select("sample_id", "arm", F.when(F.col("n_lines") % 2 == 0, F.col("total_bytes")).alias("bytes_v2"), F.col("payload").alias("bytes_v1")))),
    "l1_stop_point": lambda s, d: tidy(cohort.stop_point(layout.attempts(s, d), 2)),
    # scalar functions
    "f_scalars": lambda s, d: tidy(layout.scalars(s, d)),
    "f_code_inverse": lambda s, d: tidy(layout.code_inverse(s, d)),
}

QUERIES |= storage.QUERIES | audits.QUERIES


def _lean(query: Query) -> Query:
    """The query without the tables that were only steps on the way to its result."""
    return lambda spark, d: drop_unread(spark, lambda: query(spark, d))


QUERIES = {name: _lean(query) for name, query in QUERIES.items()}

#: DuckDB twins.
ORACLE: dict[str, str] = oracles.ORACLE | storage.ORACLE | audits.ORACLE
