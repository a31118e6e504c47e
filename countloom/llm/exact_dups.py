"""Exact duplicates by a heavy-hitter split.

Each text is reduced to its SHA-256 once; everything after that works on a narrow
table of (row, doc_id, digest). A Misra-Gries summary of the digests (DataFrame's
``freqItems``, combined on the map side) holds at most 1 / ``support`` digests and
misses none of more than ``support`` of all rows. An exact count verifies them; those
that are so frequent, with their largest row, are sent to all tasks, where their rows
are decided without a shuffle. So no digest that is left holds more than ``support`` of
all rows, and these are shuffled by digest and decided by a window in the usual way.

What is sent is bounded by the summary's size: 1 / ``support`` rows of under 100 bytes.
All of it is DataFrame functions; no row meets Python.

Defined cases: a null text is empty, so null and empty texts are equal; a null doc_id is
less than any other; of equal rows with the largest doc_id (repeated rows) one stays; an
empty table gives no rows; extra columns are ignored, or kept where documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialise

#: A digest of more than this share of all rows counts as frequent.
SUPPORT = 0.001


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))


def frequent(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, best: struct<doc_id, row>, n) of the digests that more than ``support`` of ``rows`` have; at most 1 / support rows.

    Misra-Gries proposes, a count over the proposed ones disposes.
    """
    proposed = rows.select(F.hex("digest").alias("d")).freqItems(["d"], support)
    proposed = proposed.select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("digest"))
    counted = rows.join(F.broadcast(proposed), "digest", "left_semi").groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n"))
    return counted.where(F.col("n") > support * rows.count())


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, frequent), one row per document row."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), digest().alias("digest")), "digests")
    winners = materialise(frequent(rows, support).coalesce(1), "winners")
    # At most 1 / support rows, as many as the summary has room for.
    met = rows.join(F.broadcast(winners), "digest", "left")
    heavy = met.where("n is not null").withColumn("frequent", F.lit(True))
    same = W.partitionBy("digest")
    light = met.where("n is null").select("row", "doc_id", "digest", F.max(F.struct("doc_id", "row")).over(same).alias("best"), F.count("*").over(same).alias("n"), F.lit(False).alias("frequent"))
    return heavy.unionByName(light).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "frequent"
    )


def drop_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows of frequent digests that do not stay are dropped before texts are shuffled, so
    a digest's texts that meet in one task are at most ``support`` of all, or repeated rows.
    """
    own = [f"_countloom_{c}" for c in docs.columns]
    named = docs.toDF(*own).withColumn("_digest", digest("_countloom_text")).withColumn("_id", F.col("_countloom_doc_id").cast("bigint"))
    decided = exact_duplicates(docs, support).where("kept").select("frequent", F.unhex("text_sha256").alias("_digest"), F.col("keep_id").alias("_keep"))
    decided = materialise(decided, "kept")
    # Frequent digests are at most 1 / support rows.
    first = named.join(F.broadcast(decided.where("frequent").drop("frequent")), "_digest", "left").where("_keep is null or _keep = _id").drop("_keep")
    stay = first.join(decided.drop("frequent"), "_digest").where(F.col("_keep").eqNullSafe(F.col("_id")))
    return stay.dropDuplicates(["_digest"]).select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])
