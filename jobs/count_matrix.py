"""Batch job: a table of texts as sparse count matrices, one a sample, ready for the matrix operators.

    python -m jobs.count_matrix --documents DOCS --output OUT [--config FILE] [--samples a,b]

A sample is a value of a column (the source); its rows are the documents by id, the
columns of all samples are the terms that at least ``least_documents`` documents hold, in
byte order. Written under OUT, as Parquet:

    cells/sample_id=.../   (i, doc_id, ptr_lo, ptr_hi, g, v): positive counts only, beside what rows/ has of their row (runs of equal values, so next to no bytes)
    rows/sample_id=.../    (i, doc_id, ptr_lo, ptr_hi): every document, those without a term too; row pointers into the cells
    terms/                 (g, term, documents)
    report/                (sample_id, n, genes, nnz, cells, within): sizes against a matrix's caps

A rerun gives the same files' contents: positions follow from ids and terms alone.
With --samples only these samples' partitions are written anew, by dynamic partition
overwrite (terms still come from all documents, and must be those that are there).

Null and empty samples get one name; a null doc_id is the least id; rows that repeat a
doc_id within a sample are one row, and their counts add up; null texts have no terms.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions import words
from countloom.operators.scan import scan
from countloom.operators.skew import most_frequent
from countloom.sources.matrix import CountMatrix, budget, canonicalise, ordinals, row_pointers
from countloom.sources.shared import materialise, scoped_tables

from .common import load_config, log, own_config, run_alone

DEFAULTS: dict[str, Any] = {"sample": "source", "unnamed": "unknown", "word": "[a-z0-9]+", "least_documents": 2, "rows_per_task": 50_000, "records_per_file": 5_000_000}


def term_counts(docs: DataFrame, rows: DataFrame, word: str) -> DataFrame:
    """(sample_id, i, term, v). Texts meet their rows by one shuffle, and a row's words are then all in one task: they are counted there, and rows are not looked up for every cell."""
    # A null id is the least, and a key like others inside a struct.
    keyed = rows.select("sample_id", F.struct("doc_id").alias("_id"), "i")
    texts = docs.select("sample_id", F.struct("doc_id").alias("_id"), "text").hint("shuffle_merge").join(keyed, ["sample_id", "_id"])
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = texts.select("sample_id", "_id", "i", F.explode(F.regexp_extract_all(lower, F.lit(word), F.lit(0))).alias("term"))
    return words.groupBy("sample_id", "_id", "i", "term").agg(F.count("*").alias("v")).drop("_id")


def word_counts(docs: DataFrame, rows: DataFrame, word: str) -> DataFrame:
    """The counts of ``term_counts`` in blocks (``words.BLOCK``). A row is in several of them only if no term of it is in two.

    ``rows`` says how many texts a row has. One text is counted by itself, in Arrow batches, where the words are runs
    of certain letters; rows of several texts, and other words, are counted by ``term_counts``.
    """
    if words.letters(word) is None:
        return term_counts(docs, rows, word).mapInArrow(words.blocks, words.BLOCK)
    keyed = rows.where("texts = 1").select("sample_id", F.struct("doc_id").alias("_id"), "i")
    texts = docs.select("sample_id", F.struct("doc_id").alias("_id"), "text").hint("shuffle_merge").join(keyed, ["sample_id", "_id"])
    counted = texts.select("sample_id", "i", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(words.counter(word), words.BLOCK)
    # Ids that repeat are the exception: their texts are looked for only if there are any.
    others = rows.where("texts > 1")
    return counted if others.isEmpty() else counted.unionByName(term_counts(docs, others, word).mapInArrow(words.blocks, words.BLOCK))


def place(counted: DataFrame, terms: DataFrame) -> DataFrame:
    """(sample_id, i, n, gs, vs, g, v): n terms of a row by their numbers, packed and in order, or one by itself; terms without a number are left out.

    The most frequent terms are sent to all tasks and looked up there, so their cells are not shuffled; the others meet
    their numbers by a shuffle.
    """
    frequent, rare = most_frequent(terms, "documents", F.octet_length("term") <= 64)
    known, none = frequent.select("term", "g").orderBy("g").toArrow(), rare.isEmpty()
    find = words.finder(known["term"].combine_chunks(), known["g"].to_numpy(), not none)
    looked = materialise(counted.mapInArrow(find, words.FOUND), "looked")
    null = lambda kind: F.lit(None).cast(kind)
    placed = looked.select("sample_id", "i", "n", "gs", "vs", null("bigint").alias("g"), null("bigint").alias("v"))
    if none:
        return placed
    left = looked.select("sample_id", "i", "counts", F.posexplode("terms").alias("_at", "term")).select("sample_id", "i", "term", F.get("counts", F.col("_at")).alias("v"))
    met = materialise(left.join(rare.select("term", "g"), "term").select("sample_id", "i", "g", "v"), "rare")
    return placed.unionByName(met.select("sample_id", "i", F.lit(1).cast("bigint").alias("n"), null("binary").alias("gs"), null("binary").alias("vs"), "g", "v"))


def build(spark: SparkSession, documents: str, output: str, config: dict[str, Any] | None = None, samples: list[str] | None = None) -> dict[str, int]:
    """Writes the matrices; returns how many rows were read and written."""
    config = DEFAULTS | (config or {})
    table = spark.read.parquet(documents)
    sample = F.col(f"`{config['sample']}`").cast("string")
    docs = table.select(F.coalesce(F.nullif(sample, F.lit("")), F.lit(config["unnamed"])).alias("sample_id"), "doc_id", "text")
    with scoped_tables(spark):
        axis = scan(docs.groupBy("sample_id", "doc_id").agg(F.count("*").alias("texts")), ["sample_id"], ["doc_id"], rank="i")
        rows = materialise(axis.select("sample_id", "doc_id", "i", "texts"), "rows")
        # A block is a quarter of a million cells or so.
        counted = materialise(word_counts(docs, rows, config["word"]), "terms", most=8)
        uses = counted.select("documents", F.posexplode("terms").alias("_at", "term")).groupBy("term").agg(F.sum(F.get("documents", F.col("_at"))).alias("documents"))
        seen = uses.where(F.col("documents") >= config["least_documents"])
        terms = materialise(ordinals(seen, "term", "g"), "axis")
        placed = place(counted, terms)

        wanted = F.lit(True) if samples is None else F.col("sample_id").isin(samples)
        # Whole tables are replaced, single samples by their partitions only.
        how = "static" if samples is None else "dynamic"

        def spread(part: DataFrame) -> DataFrame:
            # A sample of many rows is several tasks and files: a task sorts and writes the cells of so many rows.
            return part.where(wanted).withColumn("_block", F.floor(F.col("i") / F.lit(config["rows_per_task"]))).repartition("sample_id", "_block")

        def put(name: str, part: DataFrame, key: list[str]) -> None:
            part = part.select(*[c for c in part.columns if c != "_block"]).sortWithinPartitions("sample_id", *key)
            part.write.mode("overwrite").option("partitionOverwriteMode", how).option("maxRecordsPerFile", config["records_per_file"]).partitionBy("sample_id").parquet(f"{output}/{name}")

        pointers = row_pointers(placed, rows, size=F.col("n")).join(rows, ["sample_id", "i"])
        pointers = materialise(pointers.select("sample_id", "i", "doc_id", "ptr_lo", "ptr_hi"), "pointers")
        # Packed cells meet their row where they are written: one shuffle, and the window puts rows in order, so that the sort of the cells finds them nearly sorted.
        both = spread(placed.drop("n").unionByName(pointers, allowMissingColumns=True))
        own = W.partitionBy("sample_id", "_block", "i")
        both = both.select("sample_id", "i", *[F.max(c).over(own).alias(c) for c in ("doc_id", "ptr_lo", "ptr_hi")], "g", "v", "gs", "vs")
        both = both.mapInArrow(words.lists, "sample_id string, i bigint, doc_id bigint, ptr_lo bigint, ptr_hi bigint, gs array<bigint>, vs array<bigint>")
        row = ("sample_id", "i", "doc_id", "ptr_lo", "ptr_hi")
        cells = both.select(*row, "vs", F.posexplode("gs").alias("_at", "g")).select(*row, "g", F.get("vs", F.col("_at")).alias("v"))
        put("cells", canonicalise(cells, (*row, "g"), distinct=True), ["i", "g"])
        put("rows", spread(pointers), ["i"])
        sizes = budget(CountMatrix(placed, rows, terms.select("g")), F.col("n"))
        terms.select("g", "term", "documents").write.mode("overwrite").parquet(f"{output}/terms")
        sizes.write.mode("overwrite").parquet(f"{output}/report")
        done = {"documents_read": table.count()}
    written = read(spark, output)
    done |= {f"{name}_written": df.count() for name, df in written.items()}
    log.info("count_matrix: read %s (%d rows)", documents, done["documents_read"])
    for name in written:
        log.info("count_matrix: wrote %s/%s (%d rows)", output, name, done[f"{name}_written"])
    return done


#: Partition values such as 007 or 2024-01-01 stay the texts that they are.
SCHEMAS = {
    "cells": "i bigint, doc_id bigint, ptr_lo bigint, ptr_hi bigint, g bigint, v bigint, sample_id string", "rows": "i bigint, doc_id bigint, ptr_lo bigint, ptr_hi bigint, sample_id string",
    "terms": "g bigint, term string, documents bigint", "report": "sample_id string, n bigint, genes bigint, nnz bigint, cells bigint, within boolean",
}


def read(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """The tables of the output."""
    return {name: spark.read.schema(schema).parquet(f"{output}/{name}") for name, schema in SCHEMAS.items()}


def labelled(spark: SparkSession, output: str) -> DataFrame:
    """(sample_id, i, doc_id, ptr_lo, ptr_hi, g, term, v): cells with their labels, and rows without a cell."""
    t = read(spark, output)
    frequent, rare = (x.select("g", "term") for x in most_frequent(t["terms"], "documents", F.octet_length("term") <= 64))
    found = t["cells"].join(F.broadcast(frequent), "g")
    if not rare.isEmpty():
        found = found.unionByName(t["cells"].join(F.broadcast(frequent.select("g")), "g", "left_anti").join(rare, "g"))
    empty = t["rows"].where("ptr_lo = ptr_hi")
    return found.unionByName(empty, allowMissingColumns=True).select("sample_id", "i", "doc_id", "ptr_lo", "ptr_hi", "g", "term", "v")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--documents", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config", default=own_config(__file__))
    p.add_argument("--samples", help="names of the samples to write anew, by commas; all, if left out")
    a = p.parse_args()
    run_alone("count_matrix", lambda spark: build(spark, a.documents, a.output, load_config(spark, a.config, DEFAULTS), a.samples.split(",") if a.samples else None))


if __name__ == "__main__":
    main()
