"""Every registered query with a DuckDB twin gives the twin's rows and types."""

import glob
import math
import os

import duckdb
import pyarrow as pa
import pytest

from countloom.plans import queries
from jobs import catalog as jobs

TABLES = "region nation customer supplier part orders lineitem events documents".split()
QUERIES, ORACLE = queries.QUERIES | jobs.QUERIES, queries.ORACLE | jobs.ORACLE


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{medium}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def kind(t: pa.DataType) -> str:
    if pa.types.is_floating(t):
        return "double"
    if pa.types.is_string(t) or pa.types.is_large_string(t) or str(t) == "string_view":
        return "string"
    return str(t)


def rows(table: pa.Table) -> list[tuple]:
    cols = sorted(table.column_names)
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(fix(r[c]) for c in cols) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same(spark, duck, medium, name):
    got, want = QUERIES[name](spark, medium).toArrow(), duck.sql(ORACLE[name]).to_arrow_table()
    assert {f.name: kind(f.type) for f in got.schema} == {f.name: kind(f.type) for f in want.schema}
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["canonical_counts", "w4_row_pointers", "a1_gene_marginals", "m7_support_bits"])
def test_same_over_many_partitions(spark, duck, medium, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        test_same(spark, duck, medium, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert not glob.glob("countloom-*")
