"""Incremental job: where every run of a cohort stands, from attempts that arrive as files.

    python -m jobs.cohort_snapshot --attempts FOLDER --output OUT --checkpoint DIR [--config FILE]

A file stream takes what is new since the last run (its checkpoint knows) and ends when
all is read. Attempts may come in any order, late, or twice: one is known by (sample_id,
arm, attempt), and of several reports of it the one last seen counts. Written, as Parquet:

    OUT/attempts/bucket=.../batch=.../   the attempts as they came; a batch that is run again replaces itself
    OUT/snapshot/bucket=.../             a row for each (sample_id, arm)

snapshot: attempts and failures so far; state (done: some attempt succeeded; stopped:
``run`` failures in a row; else open); best_bytes of the successes and best_attempt that
reached it first; stop_at, the attempt that completed the first run of failures; last_seen.

Only buckets (of sample_id) with new attempts are read again and written anew, by dynamic
partition overwrite, so a run's work follows what is new times the history of its
buckets. The snapshot depends on the attempts alone, not on how they were cut into
batches; if a run is killed between the two writes, its batch runs again and both come out
the same.

Every batch adds a folder to each bucket that it touches; ``files_per_batch`` says how much one
takes, and ``buckets`` how finely work is cut (it must stay the same for an output).

Attempts whose sample, arm or attempt is null cannot be placed; they are logged and kept
under bucket=-1, out of the snapshot. Null statuses count as failed, null bytes are never best.
"""

from __future__ import annotations

import argparse
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from countloom.operators.cohort import stop_point

from .common import load_config, log, own_config, run_alone

DEFAULTS: dict[str, Any] = {
    "sample_id": "sample_id", "arm": "arm", "attempt": "attempt", "seen": "seen", "status": "status", "bytes": "bytes", "run": 2, "buckets": 16, "files_per_batch": 1000,
}
ATTEMPT = "sample_id string, arm string, attempt bigint, seen timestamp_ntz, status string, bytes bigint"
SNAPSHOT = "sample_id string, arm string, attempts bigint, failures bigint, state string, best_bytes bigint, best_attempt bigint, stop_at bigint, last_seen timestamp_ntz, bucket int"


def canonical(rows: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The columns of ATTEMPT and the bucket, from SQL expressions."""
    kinds = dict(f.split() for f in ATTEMPT.split(", "))
    x = rows.select(*[F.expr(config[c]).cast(kind).alias(c) for c, kind in kinds.items()])
    placed = F.col("sample_id").isNotNull() & F.col("arm").isNotNull() & F.col("attempt").isNotNull()
    return x.withColumn("bucket", F.when(placed, F.pmod(F.xxhash64("sample_id"), F.lit(config["buckets"]))).otherwise(-1).cast("int"))


def snapshot(attempts: DataFrame, run: int) -> DataFrame:
    """A row for each (sample_id, arm) of attempts (ATTEMPT and bucket)."""
    key = ["bucket", "sample_id", "arm"]
    last = F.max(F.struct("seen", "status", "bytes")).alias("r")
    once = attempts.groupBy(*key, "attempt").agg(last).select(*key, "attempt", "r.*")
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    best = F.min(F.when(ok & F.col("bytes").isNotNull(), F.struct("bytes", "attempt")))
    per = once.groupBy(*key).agg(F.count("*").alias("attempts"), F.count(F.when(~ok, 1)).alias("failures"), best.alias("b"), F.max("seen").alias("last_seen"))
    lanes = once.select(F.struct(*key).alias("lane"), "attempt", F.when(ok, "success").otherwise("failed").alias("status"))
    stops = stop_point(lanes, run).select("lane.*", "stop_at")
    state = F.when(F.col("failures") < F.col("attempts"), "done").when(F.col("stop_at").isNotNull(), "stopped").otherwise("open")
    return per.join(stops, key, "left").select("sample_id", "arm", "attempts", "failures", state.alias("state"), F.col("b.bytes").alias("best_bytes"), F.col("b.attempt").alias("best_attempt"), "stop_at", "last_seen", "bucket")


def arriving(spark: SparkSession, attempts: str) -> DataStreamReader:
    """A stream of a folder's files, or of a single file, for which its folder is watched."""
    now = spark.read.parquet(attempts)
    folder, name = attempts.rstrip("/").rsplit("/", 1)
    one = [unquote(f.rsplit("/", 1)[1]) for f in now.inputFiles()] == [name]
    stream = spark.readStream.format("parquet").schema(now.schema)
    return stream.option("path", folder).option("pathGlobFilter", name) if one else stream.option("path", attempts)


def update(spark: SparkSession, attempts: str, output: str, checkpoint: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Takes the attempts that are new; returns how many there were and how many rows were written."""
    config = DEFAULTS | (config or {})
    done = {"batches": 0, "attempts_read": 0, "unplaced": 0, "buckets_written": 0, "rows_written": 0}

    def take(rows: DataFrame, batch: int) -> None:
        canonical(rows, config).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{output}/attempts")
        kept = spark.read.schema(f"{ATTEMPT}, bucket int, batch bigint").parquet(f"{output}/attempts")
        # A row for each bucket.
        new = {r["bucket"]: r["count"] for r in kept.where(F.col("batch") == batch).groupBy("bucket").count().collect()}
        touched = [b for b in new if b >= 0]
        if touched:
            fresh = snapshot(kept.where(F.col("bucket").isin(touched)), config["run"])
            fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{output}/snapshot")
            done["rows_written"] += read(spark, output).where(F.col("bucket").isin(touched)).count()
        for name, n in (("batches", 1), ("attempts_read", sum(new.values())), ("unplaced", new.get(-1, 0)), ("buckets_written", len(touched))):
            done[name] += n
        log.info("cohort_snapshot: batch %d read %d attempts (%d unplaced), wrote %d buckets of %s/snapshot", batch, sum(new.values()), new.get(-1, 0), len(touched), output)

    stream = arriving(spark, attempts).option("maxFilesPerTrigger", config["files_per_batch"]).load()
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("cohort_snapshot: %s done, %s", attempts, done)
    return done


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).parquet(f"{output}/snapshot")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--attempts", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", default=own_config(__file__))
    a = p.parse_args()
    run_alone("cohort_snapshot", lambda spark: update(spark, a.attempts, a.output, a.checkpoint, load_config(spark, a.config, DEFAULTS)))


if __name__ == "__main__":
    main()
