"""Coverage of a cohort kept up to date from result files as they arrive. An extra of this engine, not a parity claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, kind, n, total) by tumbling window; rows later than the watermark are left out. Works on streams and tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def follow(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's new (sample_id, arm, status) rows of JSON lines to Parquet, exactly once by checkpoint; ends when all is read."""
    stream = spark.readStream.schema(schema).json(folder).select("sample_id", "arm", "status")
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
