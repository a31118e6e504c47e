"""The jobs as queries: each runs twice into a new folder, and gives the whole output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.sources.shared import shared_dir

from . import cohort_snapshot, count_matrix
from .common import load_config, own_config


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "count-matrix")
    config = load_config(spark, own_config(count_matrix.__file__), count_matrix.DEFAULTS)
    for _ in range(2):
        count_matrix.build(spark, f"{sf_dir}/documents.parquet", out, config)
    return count_matrix.labelled(spark, out)


def job2_cohort_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "cohort-snapshot")
    config = load_config(spark, own_config(cohort_snapshot.__file__), cohort_snapshot.DEFAULTS)
    for _ in range(2):
        cohort_snapshot.update(spark, f"{sf_dir}/events.parquet", out, f"{out}/checkpoint", config)
    # The bucket is how it is stored; microseconds of the clock on the wall depend on no time zone.
    day, second = F.datediff(F.to_date("last_seen"), F.lit("1970-01-01").cast("date")).cast("bigint"), F.expr("cast(extract(SECOND FROM last_seen) * 1000000 as bigint)")
    micros = day * 86_400_000_000 + (F.hour("last_seen") * 60 + F.minute("last_seen")).cast("bigint") * 60_000_000 + second
    return cohort_snapshot.read(spark, out).drop("bucket").withColumn("last_seen", micros)


QUERIES = {"job1_count_matrix": job1_count_matrix, "job2_cohort_snapshot": job2_cohort_snapshot}

ORACLE: dict[str, str] = {
    "job1_count_matrix": """
WITH d AS (SELECT coalesce(nullif(source, ''), 'unknown') AS sample_id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
r AS (SELECT sample_id, doc_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY doc_id NULLS FIRST) - 1 AS BIGINT) AS i FROM (SELECT DISTINCT sample_id, doc_id FROM d)),
c AS (SELECT sample_id, doc_id, term, CAST(count(*) AS BIGINT) AS v FROM (SELECT sample_id, doc_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS term FROM d) GROUP BY ALL),
g AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS g FROM (SELECT term FROM c GROUP BY term HAVING count(*) >= 2)),
x AS (SELECT r.sample_id, r.i, g.g, g.term, c.v FROM c JOIN g USING (term) JOIN r ON r.sample_id = c.sample_id AND r.doc_id IS NOT DISTINCT FROM c.doc_id),
n AS (SELECT r.sample_id, r.i, r.doc_id, count(x.g) AS n FROM r LEFT JOIN x USING (sample_id, i) GROUP BY ALL),
p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY sample_id ORDER BY i) AS BIGINT) AS ptr_hi FROM n)
SELECT p.sample_id, p.i, p.doc_id, CAST(ptr_hi - n AS BIGINT) AS ptr_lo, ptr_hi, x.g, x.term, x.v FROM p LEFT JOIN x USING (sample_id, i)
""",
    "job2_cohort_snapshot": """
WITH a AS (SELECT concat('s', user_id) AS sample_id, event_type AS arm, event_id AS attempt, ts, CASE WHEN value >= 5 THEN 'success' ELSE 'failed' END AS status, TRY_CAST(round(value * 100) AS BIGINT) AS bytes
           FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND event_id IS NOT NULL),
o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY sample_id, arm, attempt ORDER BY ts DESC NULLS LAST, status DESC, bytes DESC NULLS LAST) = 1),
f AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, arm ORDER BY attempt ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS failed FROM o),
s AS (SELECT sample_id, arm, count(*) AS attempts, count(*) FILTER (status = 'failed') AS failures, min(bytes) FILTER (status = 'success') AS best_bytes, min(attempt) FILTER (failed = 2) AS stop_at, max(epoch_us(ts)) AS last_seen FROM f GROUP BY ALL),
b AS (SELECT sample_id, arm, bytes AS best_bytes, min(attempt) AS best_attempt FROM o WHERE status = 'success' GROUP BY ALL)
SELECT sample_id, arm, attempts, failures, CASE WHEN failures < attempts THEN 'done' WHEN stop_at IS NOT NULL THEN 'stopped' ELSE 'open' END AS state, best_bytes, best_attempt, stop_at, last_seen
FROM s LEFT JOIN b USING (sample_id, arm, best_bytes)
""",
}
