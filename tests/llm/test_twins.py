"""Columns of the operators' queries that SQL can say, against DuckDB on the driver's tables."""

import math
import zlib

import duckdb
import pytest

from countloom.llm import catalog

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    con.create_function("crc32", lambda s: zlib.crc32(s.encode()), ["VARCHAR"], "BIGINT")
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    return con


def same(spark, duck, folder, name, sql, approx=()):
    got = {r["doc_id"]: r.asDict() for r in catalog.QUERIES[name](spark, folder).collect()}
    want = duck.sql(sql).to_arrow_table().to_pylist()
    assert len(want) == len(got) > 0
    for w in want:
        for column, value in w.items():
            mine = got[w["doc_id"]][column]
            assert mine == pytest.approx(value, rel=1e-9) if column in approx else mine == value, (name, w["doc_id"], column)


def test_secret_counts(spark, duck, medium):
    count = lambda p, least, group=0: f"CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{p}', {group}), lambda x: length(x) >= {least})) AS BIGINT)"
    same(spark, duck, medium, "op1_secret_scan", f"SELECT doc_id, {count(ASSIGN, 8, 1)} AS n_assign, {count('AKIA[A-Z0-9]+', 16)} AS n_access, {count('[0-9a-f]+', 32)} AS n_hex FROM documents")
    assert duck.sql(f"SELECT count(*) FILTER ({count(ASSIGN, 8, 1)} > 0) > 0 FROM documents").fetchall() == [(True,)]


def test_toxicity_folds(spark, duck, medium):
    same(spark, duck, medium, "op2_toxicity", "SELECT doc_id, crc32(CAST(doc_id AS VARCHAR)) % 5 = 0 AS held_out FROM documents")


def test_mix_targets(spark, duck, medium):
    same(
        spark, duck, medium, "op3_entropy_mix", f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY 1),
r AS (SELECT *, (SELECT sum(source_size) FROM s) - 3 * coalesce(sum(source_size) OVER w, 0) AS rest, (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS open
      FROM s WINDOW w AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT rest / open AS price FROM r WHERE rest / open < 3 * source_size / weight ORDER BY source_size / weight, source LIMIT 1)
SELECT doc_id, size, source_size, least(weight * price, 3 * source_size)::DOUBLE AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, p""", ("target",),
    )


def test_mix_reaches_targets(spark, medium):
    rows = catalog.QUERIES["op3_entropy_mix"](spark, medium).join(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, target = {}, {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.004 * target[s] for s in target)


def test_neighbours(spark, duck, medium):
    """All pairs: every distance is right, and at least nine of ten neighbours are found."""
    got = {}
    for r in catalog.QUERIES["op5_ivfpq"](spark, medium).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    pairs = duck.sql("SELECT q.vec_id AS a, v.vec_id AS b, sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS d FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id ORDER BY a, d, b").fetchall()
    exact = {}
    for a, b, d in pairs:
        exact.setdefault(a, []).append((b, d))
    assert set(got) == set(exact)
    found = 0
    for a, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        far = dict(exact[a])
        assert all(math.isclose(s, far[b], rel_tol=1e-9) for _, s, b in rows)
        found += len({b for *_, b in rows} & {b for b, _ in exact[a][:10]})
    assert found >= 9 * len(got)


def test_language_model_base(spark, duck, medium):
    same(
        spark, duck, medium, "op6_ngram_trie", f"""
WITH d AS (SELECT doc_id, crc32(CAST(doc_id AS VARCHAR)) % 7 = 2 AS held_out, list_append(regexp_extract_all({LOWER}, '{SPACED}'), chr(10)) AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)) AS base_score FROM t LEFT JOIN c USING (w), n GROUP BY 1, 2""", ("base_score",),
    )


def test_token_starts(spark, small):
    rows = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in catalog.QUERIES["op8_token_files"](spark, small).collect())
    at = 0
    for _, start, n in rows:
        assert start == at and n >= 1
        at += n
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()


def test_exact_duplicates(spark, duck, medium):
    same(spark, duck, medium, "op11_exact_dups", catalog.ORACLE["op11_exact_dups"])
