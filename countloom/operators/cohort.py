"""Cohort analytics: coverage, paired comparisons, strata, selection and audits.

``results(sample_id, arm, status, platform, species, organ, total_bytes, n_counts)``
has a row for each run; failed runs have null sizes, which are never imputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.matrix import few
from .quantiles import quantiles

STRATA = ("platform", "species", "organ")


def good(results: DataFrame) -> DataFrame:
    return results.where("status = 'success'")


def coverage(samples: DataFrame, arms: DataFrame, results: DataFrame) -> DataFrame:
    """Every planned pair with its status, ``not_run`` where there is none. arms are few."""
    plan = samples.select("sample_id").crossJoin(few(arms.select("arm")))
    return plan.join(results.select("sample_id", "arm", "status"), ["sample_id", "arm"], "left").withColumn("status", F.coalesce("status", F.lit("not_run")))


def status_counts(cover: DataFrame) -> DataFrame:
    return cover.groupBy("arm", "status").agg(F.count("*").alias("runs"))


def pairs(results: DataFrame, base: str) -> DataFrame:
    """(sample_id, arm, base_bytes, bytes, delta, percent) of samples where both succeed."""
    ok = good(results)
    b = ok.where(F.col("arm") == base).select("sample_id", F.col("total_bytes").alias("base_bytes"))
    x = ok.where(F.col("arm") != base).join(b, "sample_id")
    delta = F.col("total_bytes") - F.col("base_bytes")
    return x.select("sample_id", *STRATA, "arm", "base_bytes", F.col("total_bytes").alias("bytes"), delta.alias("delta"), (F.lit(100.0) * delta / F.col("base_bytes")).alias("percent"))


def paired_summary(results: DataFrame, base: str) -> DataFrame:
    """By arm: totals, wins, losses and ties of the base, quartiles, extremes, best saver, leave-one-out range of the pooled percentage."""
    p = pairs(results, base)
    first = p.groupBy("arm").agg(
        F.count("*").alias("n"), F.sum("base_bytes").alias("base_total"), F.sum("bytes").alias("total"),
        F.count(F.when(F.col("delta") > 0, 1)).alias("wins"), F.count(F.when(F.col("delta") < 0, 1)).alias("losses"), F.count(F.when(F.col("delta") == 0, 1)).alias("ties"),
        F.min("percent").alias("low"), F.max("percent").alias("high"),
        F.min_by("sample_id", F.struct("delta", "sample_id")).alias("best"),
    )
    # An arm has one row in ``first``: leave-one-out subtracts a sample from its sums.
    without = p.select("arm", F.col("bytes").alias("x"), F.col("base_bytes").alias("y")).join(first.select("arm", "n", "base_total", "total"), "arm").where("n > 1")
    rest = F.lit(100.0) * ((F.col("total") - F.col("x")) - (F.col("base_total") - F.col("y"))) / (F.col("base_total") - F.col("y"))
    loo = without.groupBy("arm").agg(F.min(rest).alias("loo_low"), F.max(rest).alias("loo_high"))
    return first.withColumn("pooled", F.lit(100.0) * (F.col("total") - F.col("base_total")) / F.col("base_total")).join(loo, "arm", "left").join(quantiles(p, ["arm"], "percent", {"q1": 0.25, "median": 0.5, "q3": 0.75}), "arm", "left")


def stratified(results: DataFrame, base: str) -> DataFrame:
    """Pooled comparison over all samples and by platform, species and organ: grouping sets over one pass."""
    p = pairs(results, base)
    x = p.groupingSets([["arm"], ["arm", "platform"], ["arm", "species"], ["arm", "organ"]], "arm", "platform", "species", "organ").agg(
        F.grouping("platform").alias("_p"), F.grouping("species").alias("_s"), F.grouping("organ").alias("_o"),
        F.count("*").alias("n"), F.sum("base_bytes").alias("base_total"), F.sum("bytes").alias("total"), F.count(F.when(F.col("delta") > 0, 1)).alias("wins"),
    )
    stratum = F.when(F.col("_p") == 0, "platform").when(F.col("_s") == 0, "species").when(F.col("_o") == 0, "organ").otherwise("all")
    return x.select("arm", stratum.alias("stratum"), F.coalesce("platform", "species", "organ", F.lit("all")).alias("level"), "n", "base_total", "total", "wins")


def pooled_summary(results: DataFrame) -> DataFrame:
    ok = good(results)
    return ok.groupBy("arm").agg(F.count("*").alias("n"), F.sum("total_bytes").alias("total"), F.avg("total_bytes").alias("mean"), F.sum("payload").alias("payload"), F.sum("model").alias("model"), F.sum("framing").alias("framing"))


def complete_summary(results: DataFrame) -> DataFrame:
    """With coverage: a mean and a median only say something next to how many of the expected runs there are."""
    per = results.groupBy("arm").agg(F.count("*").alias("n_expected"), F.count(F.when(F.col("status") == "success", 1)).alias("n_success"), F.sum("total_bytes").alias("total"))
    return per.join(quantiles(results, ["arm"], "total_bytes", {"median": 0.5}), "arm", "left").withColumn("complete", F.col("n_success") == F.col("n_expected"))


def module_summary(results: DataFrame, base: str) -> DataFrame:
    """By arm: mean and median change against the base, how many samples grow, and the payload's share."""
    p = pairs(results, base)
    change = p.groupBy("arm").agg(F.avg("percent").alias("mean_change"), F.count(F.when(F.col("delta") > 0, 1)).alias("n_increase"), F.min("percent").alias("least"), F.max("percent").alias("most"))
    share = good(results).groupBy("arm").agg((F.sum("payload") / F.sum("total_bytes")).alias("payload_share"))
    return share.join(change, "arm", "left").join(quantiles(p, ["arm"], "percent", {"median_change": 0.5}), "arm", "left")


def pivoted(results: DataFrame, arms: list[str]) -> DataFrame:
    """A column for each arm, for samples where all of them succeed."""
    return good(results).where(F.col("arm").isin(*arms)).groupBy("sample_id").pivot("arm", arms).agg(F.sum("total_bytes")).dropna(subset=arms)


def factorial(results: DataFrame, none: str, first: str, second: str, both: str) -> DataFrame:
    """2 x 2 decomposition by sample, and pooled: main effects and interaction."""
    w = pivoted(results, [none, first, second, both])
    pooled = w.agg(F.lit("POOLED").alias("sample_id"), *[F.sum(f"`{a}`").alias(a) for a in (none, first, second, both)])
    c = lambda a: F.col(f"`{a}`")
    effects = [(c(first) - c(none)).alias("effect_first"), (c(second) - c(none)).alias("effect_second"), (c(both) - c(first) - c(second) + c(none)).alias("interaction")]
    return w.unionByName(pooled).select("sample_id", *effects)


def weighted_ratios(results: DataFrame) -> DataFrame:
    """Bits per count: ratios of sums, not means of ratios."""
    return good(results).groupBy("arm").agg((F.sum("total_bytes") * 8 / F.sum("n_counts")).alias("bits_per_count"), (F.sum("total_bytes") * 8 / F.sum("n_lines")).alias("bits_per_nonzero"))


def quota(cohort: DataFrame, target: int, strata: list[str], key: Column) -> DataFrame:
    """Proportional selection: one of each stratum, the rest by greatest deficit.

    In a stratum of size c each further seat q has deficit target*c/N - q, which falls
    with q; so the greedy order is the order of all seats by deficit, and the seats
    taken are its head. Compared in integers. Members are taken by ``key``.
    """
    sized = cohort.groupBy(*strata).agg(F.count("*").alias("c"))
    both = sized.agg(F.sum("c").alias("total"), F.count("*").alias("n")).first()
    total, n = both["total"] or 0, both["n"]
    if n > target or target > total:
        raise ValueError("the target holds neither one of each stratum nor only members there are")
    seats = sized.where("c > 1").select(*strata, "c", F.explode(F.sequence(F.lit(1), F.col("c") - 1)).alias("q"))
    deficit = F.lit(target).cast("bigint") * F.col("c") - F.col("q") * total
    # Only seats that could be among the first target - n: the global head, by a top-k.
    head = seats.orderBy(deficit.desc(), *strata).limit(max(0, target - n)).groupBy(*strata).agg((F.count("*") + 1).alias("quota"))
    quotas = sized.select(*strata).join(head, strata, "left").withColumn("quota", F.coalesce("quota", F.lit(1)))
    ranked = cohort.withColumn("place", F.row_number().over(W.partitionBy(*strata).orderBy(key, "id")))
    return ranked.join(quotas, strata).where("place <= quota")


def hash_ranked(cohort: DataFrame, salt: str, n: int) -> DataFrame:
    """The n ids of least salted digest."""
    return cohort.withColumn("digest", F.sha2(F.concat(F.lit(salt), F.col("id")), 256)).orderBy("digest", "id").limit(n)


def queue(cohort: DataFrame, arms: DataFrame, gate: str) -> DataFrame:
    return cohort.select("id").crossJoin(few(arms.select("arm"))).withColumn("state", F.when(F.lit(gate) == "passed", "ready").otherwise("held"))


def reconcile(cohort: DataFrame, prior: DataFrame) -> DataFrame:
    """Prior readiness onto the cohort; unknown ids are unexposed and not ready."""
    p = prior.select("id", F.col("ready").alias("_ready"), F.col("seen").alias("_seen"))
    return cohort.select("id").join(p, "id", "left").select("id", F.coalesce("_ready", F.lit(False)).alias("ready"), (F.coalesce("_seen", F.lit(False)) | F.coalesce("_ready", F.lit(False))).alias("exposed"))


def member_difference(base: DataFrame, other: DataFrame) -> DataFrame:
    """By archive: members added, removed, changed and equal."""
    a = base.select("archive_id", "member", F.col("sha256").alias("x"))
    b = other.select("archive_id", "member", F.col("sha256").alias("y"))
    j = a.join(b, ["archive_id", "member"], "full_outer")
    kind = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") == F.col("y"), "equal").otherwise("changed")
    n = lambda k: F.count(F.when(kind == k, 1)).alias(k)
    return j.groupBy("archive_id").agg(n("added"), n("removed"), n("changed"), n("equal"))


def manifest_faults(manifest: DataFrame, members: DataFrame) -> DataFrame:
    """Members that are missing, unexpected, or of another size or digest."""
    a = manifest.select("archive_id", "member", F.col("bytes").alias("want"), F.col("sha256").alias("x"))
    b = members.select("archive_id", "member", F.col("bytes").alias("have"), F.col("sha256").alias("y"))
    j = a.join(b, ["archive_id", "member"], "full_outer")
    fault = F.when(F.col("x").isNull(), "unexpected").when(F.col("y").isNull(), "missing").when(F.col("want") != F.col("have"), "size").when(F.col("x") != F.col("y"), "digest")
    return j.select("archive_id", "member", fault.alias("fault")).where("fault is not null")


def pin_bridge(historical: DataFrame, kept: DataFrame, released: DataFrame) -> DataFrame:
    """Historical digests against kept and released ones; null where there is nothing to compare."""
    h = historical.select("path", F.col("sha256").alias("h"))
    k = kept.select("path", F.col("sha256").alias("k"))
    r = released.select("path", F.col("sha256").alias("r"))
    return h.join(k, "path", "left").join(r, "path", "left").select("path", (F.col("h") == F.col("k")).alias("kept_match"), (F.col("h") == F.col("r")).alias("released_match"))


def outstanding(plan: DataFrame, reusable: DataFrame) -> DataFrame:
    return plan.join(reusable.select("sample_id", "arm"), ["sample_id", "arm"], "left_anti")


def ledger(members: DataFrame, categories: DataFrame, totals: DataFrame) -> DataFrame:
    """(archive_id, category, bytes): bytes by category; framing is what a file has beyond its members."""
    c = members.join(few(categories), "member", "left").groupBy("archive_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.sum("bytes").alias("bytes"))
    inside = members.groupBy("archive_id").agg(F.sum("bytes").alias("inside"))
    framing = totals.join(inside, "archive_id").select("archive_id", F.lit("framing").alias("category"), (F.col("total") - F.col("inside")).alias("bytes"))
    return c.unionByName(framing)


def conservation_faults(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Archives whose ledger does not sum to their file."""
    s = entries.groupBy("archive_id").agg(F.sum("bytes").alias("sum"), F.min("bytes").alias("least"))
    return totals.join(s, "archive_id", "left").where(F.col("sum").isNull() | (F.col("sum") != F.col("total")) | (F.col("least") < 0)).select("archive_id", "total", "sum")


def coverage_audit(results: DataFrame, arms: int) -> DataFrame:
    """Samples without every arm once, or of several identities."""
    return results.groupBy("sample_id").agg(F.count("*").alias("rows"), F.countDistinct("arm").alias("arms"), F.countDistinct("identity").alias("identities")).where((F.col("rows") != arms) | (F.col("arms") != arms) | (F.col("identities") != 1))


def recompute_audit(results: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Rows whose stored sums or ratios are not what their parts give."""
    parts = F.col("payload") + F.col("model") + F.col("framing")
    bpc = F.col("total_bytes") * 8 / F.col("n_counts")
    return good(results).where((parts != F.col("total_bytes")) | (F.abs(bpc - F.col("bpc")) > tolerance)).select("sample_id", "arm")


def near_minimum(summary: DataFrame, value: str, prefer: str, slack: float) -> DataFrame:
    """Of the arms within ``slack`` of the least, the one of least ``prefer``."""
    least = summary.agg(F.min(value).alias("_least"))
    ok = summary.crossJoin(F.broadcast(least)).where(F.col(value) <= F.col("_least") * (1 + slack)).drop("_least")
    return ok.orderBy(prefer).limit(1)


def flagged_near_minimum(summary: DataFrame, value: str, slack: float) -> DataFrame:
    """Adds threshold and selected: which arms are within ``slack`` of the least."""
    least = F.broadcast(summary.agg(F.min(value).alias("_least")))
    out = summary.crossJoin(least)
    return out.select(*summary.columns, (F.col("_least") * slack).alias("threshold"), (F.col(value) - F.col("_least") <= F.col("_least") * slack).alias("selected"))


def gates(results: DataFrame, base: str, least_percent: float) -> DataFrame:
    """(arm, saved_percent, no_slice_worse, passed): what an arm saves over all samples, and whether any sample loses."""
    p = pairs(results, base).groupBy("arm").agg((F.lit(100.0) * (F.sum("base_bytes") - F.sum("bytes")) / F.sum("base_bytes")).alias("saved_percent"), F.bool_and(F.col("delta") <= 0).alias("no_slice_worse"))
    return p.withColumn("passed", (F.col("saved_percent") >= least_percent) & F.col("no_slice_worse"))


def stage_audit(results: DataFrame, stages: DataFrame, retry: DataFrame) -> DataFrame:
    """(stage, expected, main, retried, complete): successes of each stage's arms, in the main run or the retry, against samples times arms."""
    sizes = F.broadcast(results.agg(F.countDistinct("sample_id").alias("_samples")))
    own = few(stages)
    first = effective(results.select("sample_id", "arm", "status"), retry.select("sample_id", "arm", "status")).join(own, "arm")
    good_ = F.col("status") == "success"
    got = first.groupBy("stage").agg(F.count(F.when(good_ & (F.col("origin") == "main"), 1)).alias("main"), F.count(F.when(good_ & (F.col("origin") == "retry"), 1)).alias("retried"))
    due = stages.groupBy("stage").agg(F.count("*").alias("_arms")).crossJoin(sizes).select("stage", (F.col("_arms") * F.col("_samples")).alias("expected"))
    out = due.join(got, "stage", "left").na.fill(0, ["main", "retried"])
    return out.withColumn("complete", F.col("main") + F.col("retried") == F.col("expected"))


def fixed_member_faults(anchor: DataFrame, other: DataFrame, fixed: tuple[str, ...]) -> DataFrame:
    """(archive_id, member, fault): fixed members that are missing from the anchor or differ from it."""
    a = anchor.where(F.col("member").isin(*fixed)).select("archive_id", "member", F.col("sha256").alias("x"))
    b = other.select("archive_id", "member", F.col("sha256").alias("y"))
    due = anchor.select("archive_id").distinct().withColumn("member", F.explode(F.array(*[F.lit(x) for x in fixed])))
    j = due.join(a, ["archive_id", "member"], "left").join(b, ["archive_id", "member"], "left")
    fault = F.when(F.col("x").isNull() | F.col("y").isNull(), "missing").when(F.col("x") != F.col("y"), "changed")
    return j.select("archive_id", "member", fault.alias("fault")).where("fault is not null")


def path_index(rows: DataFrame) -> DataFrame:
    """(path, sha256, kept_as): every path, and the path under which its contents are kept once."""
    path = F.concat(F.col("archive_id").cast("string"), F.lit("/"), F.col("member"))
    each = rows.select(path.alias("path"), "sha256")
    return each.join(each.groupBy("sha256").agg(F.min("path").alias("kept_as")), "sha256").select("path", "sha256", "kept_as")


def bridge(manifest: DataFrame, kept: DataFrame) -> DataFrame:
    """(archive_id, members, blobs, faults, pins_kept, passed): a manifest against what is kept, by archive."""
    a = manifest.select("archive_id", "member", F.col("bytes").alias("want"), F.col("sha256").alias("x"))
    b = kept.select("archive_id", "member", F.col("bytes").alias("have"), F.col("sha256").alias("y"))
    j = a.join(b, ["archive_id", "member"], "full_outer")
    wrong = F.col("x").isNull() | F.col("y").isNull() | (F.col("want") != F.col("have")) | (F.col("x") != F.col("y"))
    out = j.groupBy("archive_id").agg(F.count("x").alias("members"), F.countDistinct("x").alias("blobs"), F.count(F.when(wrong, 1)).alias("faults"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("pins_kept"))
    return out.withColumn("passed", F.col("faults") == 0)


def next_actions(attempts: DataFrame, most: int = 2) -> DataFrame:
    """(sample_id, arm, attempts, action): what a resumed run does with each pair.

    done: some attempt succeeded; stop: counts came back wrong, which no retry mends;
    retry: the last attempt crashed in native code and attempts are left; else failed.
    """
    broken = F.col("status").isin("EXACT_MISMATCH", "DECODE_FAILED")
    crash = (F.col("status") == "ENCODE_FAILED") & outcome(F.lit("failed"), F.lit(""), F.col("message")).eqNullSafe("native_runtime_crash")
    per = attempts.groupBy("sample_id", "arm").agg(F.count("*").alias("attempts"), F.bool_or(F.col("status") == "success").alias("_ok"), F.bool_or(broken).alias("_broken"), F.max_by(crash, "attempt").alias("_crash"))
    action = F.when(F.col("_ok"), "done").when(F.col("_broken"), "stop").when(F.col("_crash") & (F.col("attempts") < most), "retry").otherwise("failed")
    return per.select("sample_id", "arm", "attempts", action.alias("action"))


def seed_of(arm: str) -> int:
    """The number after the last underscore of an arm's name."""
    return int(arm.rsplit("_", 1)[1])


def seed_column(arm: Column) -> Column:
    """The same as a column; null where there is none."""
    last = F.substring_index(arm, "_", -1)
    return F.when(last.rlike("^[0-9]+$") & arm.contains("_"), last.try_cast("bigint"))


def three_way(low: Column, high: Column) -> Column:
    return F.when(low > 0, "supported").when(high < 0, "not_supported").otherwise("inconclusive")


def effective(main: DataFrame, retry: DataFrame) -> DataFrame:
    """The first good of main and retry, else the main row."""
    both = main.withColumn("_p", F.lit(0)).unionByName(retry.withColumn("_p", F.lit(1)))
    w = W.partitionBy("sample_id", "arm").orderBy(F.when(F.col("status") == "success", 0).otherwise(1), "_p")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("origin", F.when(F.col("_p") == 0, "main").otherwise("retry")).drop("_p", "_r")


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(each.alias("e")).groupBy("e.field", "e.value").agg(F.count("*").alias("n"))


def legacy(rows: DataFrame) -> DataFrame:
    """One schema of two generations of receipts."""
    return rows.select("sample_id", "arm", F.coalesce("bytes_v2", "bytes_v1").alias("bytes"), F.when(F.col("bytes_v2").isNotNull(), 2).when(F.col("bytes_v1").isNotNull(), 1).alias("schema"))


# Fixed values.
DOORS = ("data", "code", "environment", "preregistration")


def gate(doors: DataFrame) -> DataFrame:
    """(release, status): pending while the data door waits, blocked while another does or is missing, else passed."""
    ok = lambda d: F.coalesce(F.bool_or((F.col("door") == d) & (F.col("state") == "passed")), F.lit(False))
    others = ok(DOORS[1]) & ok(DOORS[2]) & ok(DOORS[3])
    return doors.groupBy("release").agg(F.when(~ok(DOORS[0]), "pending").when(~others, "blocked").otherwise("passed").alias("status"))


STATES = ("pending", "passed", "failed")


def evidence_faults(doors: DataFrame) -> DataFrame:
    """(release, door, fault) of doors(release, door, state, evidence, sha256) that are not what they say.

    Faults, the first that applies: door and state that are not known, a passed door
    without evidence, a digest that is not one, and evidence of another digest.
    """
    passed = F.col("state") == "passed"
    fault = (
        F.when(F.col("door").isNull() | ~F.col("door").isin(*DOORS), "door").when(F.col("state").isNull() | ~F.col("state").isin(*STATES), "state").when(passed & F.col("evidence").isNull(), "evidence")
        .when(passed & ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest").when(passed & (F.sha2("evidence", 256) != F.col("sha256")), "mismatch")
    )
    return doors.select("release", "door", fault.alias("fault")).where("fault is not null")


def evidenced_gate(doors: DataFrame) -> DataFrame:
    """(release, status): as ``gate``, but only doors without faults count."""
    bad = evidence_faults(doors).select("release", "door").distinct()
    return gate(doors.select("release", "door").distinct().join(doors.join(bad, ["release", "door"], "left_anti").select("release", "door", "state"), ["release", "door"], "left").withColumn("state", F.coalesce("state", F.lit("failed"))))


# Patterns of messages in order; the first that matches names the outcome.
OUTCOMES = (
    (r"(?i)access violation|Fatal Python error: Aborted|returncode.*3221225477", "native_runtime_crash"),
    (r"duplicate decoded index", "ivcsc_native_duplicate_index"),
    (r"Invalid index width", "ivcsc_native_index_width"),
    (r"(?i)dict_keyiterator|list_iterator.*not callable|anndata.*zarr|zarr.*import", "python_package_compatibility"),
    (r"SystemError\('error return without exception set'\)", "python_extension_nonzero"),
)


def outcome(status: Column, method: Column, message: Column) -> Column:
    """Why a run ended as it did; a crash of the shared method is its own outcome."""
    out = F.when(status.isin("pending_adapter", "success"), status)
    for pattern, name in OUTCOMES:
        own = F.when(method == "Shared", "shared_numba_runtime_crash").otherwise(name) if name == "native_runtime_crash" else F.lit(name)
        out = out.when(message.rlike(pattern), own)
    return out.otherwise("unclassified_nonzero_exit")


def safe_name(name: Column) -> Column:
    """No absolute path, parent step, backslash or colon."""
    return ~(name.rlike(r"^/|(^|/)\.\.(/|$)|\\|:") | (name == ""))


def stop_point(attempts: DataFrame, run: int = 4) -> DataFrame:
    """(lane, stop_at): the first attempt that completes ``run`` failures in a row."""
    w = W.partitionBy("lane").orderBy("attempt").rowsBetween(-(run - 1), 0)
    failed = (F.col("status") != "success").cast("int")
    return attempts.withColumn("_f", F.sum(failed).over(w)).where(F.col("_f") == run).groupBy("lane").agg(F.min("attempt").alias("stop_at"))
