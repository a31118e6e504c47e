"""Registered queries of ledgers, audits, selection rules and scalar functions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import cohort, layout
from . import oracles
from .inputs import NAMES, Query, members, named_members, results, tidy

# Which members belong to which category, by kind of ledger.
SUPPORT_MODEL = ("base_probability.bz2", "shared_odds.u32")
VALUE_MODEL = ("value_q1.bz2", "value_group.bz2", "value_base_k.bz2", "value_odds.u32", "value_cond_k.bz2")
GRAPHS = ("graph.bz2", "support_graph.bz2", "value_graph_tail.bz2")
_STREAMS = {"support_stream": ("support.rans",), "value_stream": ("values.rans",), "support_model": SUPPORT_MODEL, "value_model_and_group_map": VALUE_MODEL}
LEDGERS: dict[str, dict[str, tuple[str, ...]]] = {
    "physical": {"payload_streams": ("support.rans", "values.rans"), "paid_model_members": SUPPORT_MODEL + VALUE_MODEL, "identity_coordinates": ("metadata.bz2",), "graph_index": ("graph.bz2",), "manifest": ("manifest.json",)},
    "k32": {**_STREAMS, "graph": ("graph.bz2",), "identity_coordinate_metadata": ("metadata.bz2",), "manifest": ("manifest.json",)},
    "ablation": {**_STREAMS, "graph_index": GRAPHS, "identity_coordinates_metadata": ("metadata.bz2",), "mapping": ("order_map.u32",), "manifest": ("manifest.json",)},
    "support": {**_STREAMS, "value_graph": ("graph.bz2",), "support_graph_increment": ("support_graph.bz2",), "identity_coordinates": ("metadata.bz2",), "manifest": ("manifest.json",)},
    "module": {**_STREAMS, "graph_index": GRAPHS, "identity_coordinates_metadata": ("metadata.bz2",), "manifest": ("manifest.json",)},
}
#: Fixed value: members that a change of the support model must leave alone.
FIXED = (*VALUE_MODEL, "values.rans", "graph.bz2", "base_probability.bz2", "metadata.bz2")


def ledgers(spark: SparkSession, d: str) -> DataFrame:
    """Bytes by category under all kinds of ledgers; framing is what files have beyond their members."""
    m = named_members(spark, d, "a")
    totals = m.groupBy("archive_id").agg((F.sum("bytes") + F.count("*") * 3).alias("total"))
    out = None
    for kind, categories in LEDGERS.items():
        table = spark.createDataFrame([(x, c) for c, names in categories.items() for x in names], "member string, category string")
        one = cohort.ledger(m, table, totals).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return tidy(out.groupBy("kind", "category").agg(F.sum("bytes").alias("bytes"), F.countDistinct("archive_id").alias("archives")))


def fixed_members(spark: SparkSession, d: str) -> DataFrame:
    """Archives and members that must not differ from the anchor's, and do."""
    return tidy(cohort.fixed_member_faults(named_members(spark, d, "a"), named_members(spark, d, "b"), FIXED))


STAGES = {"order": ("L1", "L2"), "context": ("L3", "L4"), "bucket": ("L5", "L6", "L7")}


def stage_audit(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    stages = spark.createDataFrame([(a, s) for s, arms in STAGES.items() for a in arms], "arm string, stage string")
    return tidy(cohort.stage_audit(r, stages, r.where("n_lines % 4 = 0").withColumn("status", F.lit("success"))))


def bridge(spark: SparkSession, d: str) -> DataFrame:
    """An evidence bridge in one row an archive: blobs, members, faults against the manifest, and pins that hold."""
    a, b = members(spark, d, "a"), members(spark, d, "b")
    return tidy(cohort.bridge(a, b))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts by order, told by their keys: status and what the log says."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "success").when(k % 5 == 1, "EXACT_MISMATCH").otherwise("ENCODE_FAILED")
    return o.select((k % 60).alias("sample_id"), (F.floor(k / 60) % 4).alias("arm"), k.alias("attempt"), status.alias("status"), F.when(k % 3 == 0, "access violation").otherwise("exit 1").alias("message"))


def scalars_of_text(spark: SparkSession, d: str) -> DataFrame:
    """Seeds out of names, fields out of JSON, whether all checks hold, and encodings."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("k"), "p_name")
    arm = F.concat(F.when(F.col("k") % 3 == 0, "S2_shuffle_").when(F.col("k") % 3 == 1, "RANDOM_SEED_").otherwise("plain"), (F.col("k") % 50).cast("string"))
    doc = F.concat(F.lit('{"exact":{"checks":{"counts":'), F.when(F.col("k") % 7 == 0, "false").otherwise("true"), F.lit(',"shape":true},"n":'), F.col("k").cast("string"), F.lit("}}"))
    checks = F.from_json(F.get_json_object(doc, "$.exact.checks"), "map<string,boolean>")
    return tidy(p.select("k", cohort.seed_column(arm).alias("seed"), F.get_json_object(doc, "$.exact.n").cast("bigint").alias("n"), F.forall(F.map_values(checks), lambda x: x).alias("all_hold"), F.base64(F.encode("p_name", "UTF-8")).alias("name64"), F.sha2("p_name", 256).alias("name256")))


def packed(spark: SparkSession, d: str) -> DataFrame:
    """12-bit packing by size, and back."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("bigint").alias("size"), F.col("p_partkey").cast("bigint").alias("k"))
    by = p.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("k") * 37 % 4096).alias("v")))).alias("s")).select("size", F.col("s.v").alias("v"))
    both = by.select("size", "v", numbers.pack12(F.col("v")).alias("hex"))
    return tidy(both.select("size", F.lower("hex").alias("hex"), (numbers.unpack12(F.col("hex"), F.size("v")) == F.col("v")).alias("back")))


def exact_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums of logarithms by sample and arm, added without rounding."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("sample_id"), F.col("l_linenumber").cast("bigint").alias("arm"), F.col("l_quantity").cast("double").alias("q"))
    return tidy(numbers.exact_sum(line, ["sample_id", "arm"], F.log2((F.col("q") + 1) / (F.col("arm") + 1)), "bits"))


QUERIES: dict[str, Query] = {
    "p10_evidence_faults": lambda s, d: tidy(cohort.evidence_faults(layout.evidence(s, d))),
    "p10_evidenced_gate": lambda s, d: tidy(cohort.evidenced_gate(layout.evidence(s, d))),
    "c6_ledger_variants": ledgers,
    "c13_stage_audit": stage_audit,
    "c14_fixed_members": fixed_members,
    "c16_bridge": bridge,
    "c19_bucket_rule": lambda s, d: tidy(cohort.flagged_near_minimum(cohort.pooled_summary(results(s, d)).select("arm", "total"), "total", 0.0005)),
    "c19_gates": lambda s, d: tidy(cohort.gates(results(s, d), "L1", 1.0)),
    "c23_next_actions": lambda s, d: tidy(cohort.next_actions(attempts(s, d))),
    "io19_path_index": lambda s, d: tidy(cohort.path_index(members(s, d, "a").unionByName(members(s, d, "b").withColumn("archive_id", F.col("archive_id") + 100)))),
    "f_text": scalars_of_text,
    "f_compensated": exact_sums,
    "f_pack12": packed,
}

_NAMED = f"""WITH nm AS (SELECT CAST(l_orderkey % 25 AS BIGINT) AS archive_id, ['{"', '".join(NAMES)}'][(l_orderkey + l_linenumber) % {len(NAMES)} + 1] AS member, count(*) AS bytes, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
na AS (SELECT archive_id, member, bytes, sha256(member || ':' || CAST(q AS VARCHAR) || ':' || CASE WHEN q % 5 = 0 THEN 'a' ELSE '' END) AS x FROM nm),
nb AS (SELECT archive_id, member, bytes, sha256(member || ':' || CAST(q AS VARCHAR) || ':' || CASE WHEN q % 5 = 0 THEN 'b' ELSE '' END) AS x FROM nm)
"""


def _ledger(kind: str) -> str:
    case = " ".join(f"WHEN member = '{x}' THEN '{c}'" for c, names in LEDGERS[kind].items() for x in names)
    return f"SELECT '{kind}' AS kind, CASE {case} ELSE 'other' END AS category, archive_id, bytes FROM nm UNION ALL SELECT '{kind}', 'framing', archive_id, count(*) * 3 FROM nm GROUP BY archive_id"


_ATTEMPTS = """WITH t AS (SELECT o_orderkey % 60 AS sample_id, (o_orderkey // 60) % 4 AS arm, o_orderkey AS attempt, CASE o_orderkey % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'EXACT_MISMATCH' ELSE 'ENCODE_FAILED' END AS status, o_orderkey % 3 = 0 AS crash FROM orders),
l AS (SELECT sample_id, arm, count(*) AS n, bool_or(status = 'success') AS ok, bool_or(status = 'EXACT_MISMATCH') AS bad, arg_max(status = 'ENCODE_FAILED' AND crash, attempt) AS last_crash FROM t GROUP BY 1, 2)
"""
_DOORS = """WITH g AS (SELECT o_orderkey % 37 AS release, o_orderkey % 4 AS n, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
e AS (SELECT release, n, ['data', 'code', 'environment', 'preregistration'][n + 1] AS door, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 17 = 0 THEN 'evidence' WHEN k % 13 = 0 THEN 'digest' WHEN k % 11 = 0 THEN 'mismatch' END AS fault, k % 5 <> 0 AS passed FROM g)
"""
_SIZES = "SELECT arm, CAST(sum(total_bytes) AS BIGINT) AS total FROM ok GROUP BY 1"

ORACLE: dict[str, str] = {
    "p10_evidence_faults": _DOORS + "SELECT CAST(release AS BIGINT) AS release, door, fault FROM e WHERE fault IS NOT NULL",
    "p10_evidenced_gate": _DOORS + "SELECT CAST(release AS BIGINT) AS release, CASE WHEN count(*) FILTER (WHERE n = 0 AND passed AND fault IS NULL) = 0 THEN 'pending' WHEN count(*) FILTER (WHERE passed AND fault IS NULL) < 4 THEN 'blocked' ELSE 'passed' END AS status FROM e GROUP BY 1",
    "c6_ledger_variants": _NAMED + "SELECT kind, category, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT archive_id) AS archives FROM (" + " UNION ALL ".join(_ledger(k) for k in LEDGERS) + ") GROUP BY 1, 2",
    "c13_stage_audit": oracles.RESULTS + ", st AS (SELECT r.*, CASE WHEN arm IN ('L1', 'L2') THEN 'order' WHEN arm IN ('L3', 'L4') THEN 'context' ELSE 'bucket' END AS stage FROM r)"
    " SELECT stage, CAST((SELECT count(DISTINCT sample_id) FROM r) * CASE stage WHEN 'bucket' THEN 3 ELSE 2 END AS BIGINT) AS expected, count(*) FILTER (WHERE status = 'success') AS main, count(*) FILTER (WHERE status <> 'success' AND n_lines % 4 = 0) AS retried,"
    " count(*) FILTER (WHERE status = 'success' OR n_lines % 4 = 0) = (SELECT count(DISTINCT sample_id) FROM r) * CASE stage WHEN 'bucket' THEN 3 ELSE 2 END AS complete FROM st GROUP BY 1",
    "c14_fixed_members": _NAMED + "SELECT a.archive_id, a.member, 'changed' AS fault FROM na a JOIN nb b USING (archive_id, member) WHERE a.x <> b.x AND a.member IN (" + ", ".join(f"'{x}'" for x in FIXED) + ")"
    " UNION ALL SELECT i.archive_id, f.member, 'missing' FROM (SELECT DISTINCT archive_id FROM nm) i CROSS JOIN (SELECT unnest([" + ", ".join(f"'{x}'" for x in FIXED) + "]) AS member) f WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.archive_id = i.archive_id AND nm.member = f.member)",
    "c16_bridge": oracles.MEMBERS + "SELECT archive_id, count(x) AS members, count(DISTINCT x) AS blobs, count(*) FILTER (WHERE x IS NULL OR y IS NULL OR want <> have OR x <> y) AS faults, count(*) FILTER (WHERE x = y) AS pins_kept, count(*) FILTER (WHERE x IS NULL OR y IS NULL OR want <> have OR x <> y) = 0 AS passed FROM j GROUP BY 1",
    "c19_bucket_rule": oracles.RESULTS + f"SELECT arm, total, round((SELECT min(total) FROM ({_SIZES})) * CAST(0.0005 AS DOUBLE), 6) AS threshold, total - (SELECT min(total) FROM ({_SIZES})) <= (SELECT min(total) FROM ({_SIZES})) * CAST(0.0005 AS DOUBLE) AS selected FROM ({_SIZES})",
    "c19_gates": oracles.RESULTS + "SELECT arm, round(100.0::DOUBLE * (sum(base_bytes) - sum(bytes)) / sum(base_bytes), 6) AS saved_percent, bool_and(delta <= 0) AS no_slice_worse, 100.0::DOUBLE * (sum(base_bytes) - sum(bytes)) / sum(base_bytes) >= 1 AND bool_and(delta <= 0) AS passed FROM pr GROUP BY 1",
    "c23_next_actions": _ATTEMPTS + "SELECT CAST(sample_id AS BIGINT) AS sample_id, CAST(arm AS BIGINT) AS arm, n AS attempts, CASE WHEN ok THEN 'done' WHEN bad THEN 'stop' WHEN last_crash AND n < 2 THEN 'retry' ELSE 'failed' END AS action FROM l",
    "io19_path_index": oracles.MEMBERS + ", u AS (SELECT archive_id, member, bytes, sha256 FROM a UNION ALL SELECT archive_id + 100, member, bytes, sha256 FROM b) SELECT CAST(archive_id AS VARCHAR) || '/' || member AS path, sha256, min(CAST(archive_id AS VARCHAR) || '/' || member) OVER (PARTITION BY sha256) AS kept_as FROM u",
    "f_text": "SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey % 50 AS BIGINT) END AS seed, CAST(p_partkey AS BIGINT) AS n, p_partkey % 7 <> 0 AS all_hold, to_base64(encode(p_name)) AS name64, sha256(p_name) AS name256 FROM part",
    "f_compensated": "SELECT l_returnflag AS sample_id, CAST(l_linenumber AS BIGINT) AS arm, round(sum(log2((CAST(l_quantity AS DOUBLE) + 1) / (l_linenumber + 1))), 6) AS bits FROM lineitem GROUP BY 1, 2",
    "f_pack12": "WITH v AS (SELECT CAST(p_size AS BIGINT) AS size, p_partkey * 37 % 4096 AS v, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n FROM part), pr AS (SELECT size, n // 2 AS j, max(CASE WHEN n % 2 = 0 THEN v END) AS a, max(CASE WHEN n % 2 = 1 THEN v END) AS b FROM v GROUP BY 1, 2)"
    " SELECT size, string_agg(CASE WHEN b IS NULL THEN printf('%02x%02x', CAST(a & 255 AS INT), CAST(a >> 8 AS INT)) ELSE printf('%02x%02x%02x', CAST(a & 255 AS INT), CAST((a >> 8) | ((b & 15) << 4) AS INT), CAST(b >> 4 AS INT)) END, '' ORDER BY j) AS hex, true AS back FROM pr GROUP BY 1",
}
