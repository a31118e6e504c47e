"""Jobs: reruns, growing input, killed runs and odd rows."""

import json
import re
import subprocess
import sys
from collections import Counter, defaultdict

import pytest

from jobs import catalog, cohort_snapshot, common, count_matrix

CONFIG = {"run": 2, "buckets": 4}
ROWS = "sample_id string, arm string, attempt bigint, seen timestamp_ntz, status string, bytes bigint"


def test_no_optional_parts():
    code = "import sys; from jobs import catalog; assert not [m for m in sys.modules if m.startswith('countloom.llm') or m == 'corpus_pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=re.sub(r"/tests/[^/]*$", "", __file__), timeout=120).returncode == 0


def test_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"run": 5}))
    assert common.load_config(spark, f"file://{path}", {"run": 1, "buckets": 2}) == {"run": 5, "buckets": 2}
    path.write_text(json.dumps({"typo": 5}))
    with pytest.raises(ValueError, match="typo"):
        common.load_config(spark, str(path), {"run": 1})
    for module in (count_matrix, cohort_snapshot):
        assert set(common.load_config(spark, common.own_config(module.__file__), module.DEFAULTS)) == set(module.DEFAULTS)


def test_command_lines(spark, small, tmp_path):
    """Both jobs from the command line, the second one twice."""
    base = [sys.executable, "-m"]
    run = lambda *a: subprocess.run([*base, *a], cwd=re.sub(r"/tests/[^/]*$", "", __file__), timeout=300, capture_output=True, text=True)
    (tmp_path / "c.json").write_text(json.dumps({"least_documents": 3}))
    done = run("jobs.count_matrix", "--documents", f"{small}/documents.parquet", "--output", f"{tmp_path}/matrix", "--config", f"{tmp_path}/c.json")
    assert done.returncode == 0 and "count_matrix: wrote" in done.stderr, done.stderr[-2000:]
    assert spark.read.parquet(f"{tmp_path}/matrix/terms").selectExpr("min(documents)").first()[0] == 3
    for want in ("batch 0 read", "'batches': 0"):
        done = run("jobs.cohort_snapshot", "--attempts", f"{small}/events.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark")
        assert done.returncode == 0 and want in done.stderr, done.stderr[-2000:]
    assert cohort_snapshot.read(spark, f"{tmp_path}/out").count() > 0


# -- count_matrix ------------------------------------------------------------------


DOCS = [
    (1, "a b a", "s1"), (2, "", "s1"), (3, None, "s1"), (5, "B c!", "s1"), (5, "b b", "s1"), (None, "a", "s1"), (7, "a only", None), (8, "zz", "unknown"), (9, "c a é", "007"), (1, "é", "2024-01-01"), (11, "a b", ""), (12, "a", "x/y=z %"),
]


def plain(docs, least=2):
    cells, rows = Counter(), defaultdict(set)
    for i, t, s in docs:
        rows[s or "unknown"].add(i)
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            cells[s or "unknown", i, w] += 1
    df = Counter(w for _, _, w in cells)
    terms = sorted(w for w in df if df[w] >= least)
    order = {(s, i): n for s, ids in rows.items() for n, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0)))}
    return Counter({(s, order[s, i], i, terms.index(w), w, v) for (s, i, w), v in cells.items() if w in terms}), order


def docs_at(spark, tmp_path, rows=DOCS):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, term string").repartition(3).write.mode("overwrite").parquet(path)
    return path


def cells(spark, out):
    return Counter((r["sample_id"], r["i"], r["doc_id"], r["g"], r["term"], r["v"]) for r in count_matrix.labelled(spark, out).where("g is not null").collect())


def test_count_matrix(spark, tmp_path):
    docs, out = docs_at(spark, tmp_path), f"file://{tmp_path}/out"
    first = count_matrix.build(spark, docs, out)
    want, order = plain(DOCS)
    assert cells(spark, out) == want
    t = count_matrix.read(spark, out)
    assert {(r["sample_id"], r["doc_id"]): r["i"] for r in t["rows"].collect()} == order
    assert all(r["within"] and r["genes"] == t["terms"].count() for r in t["report"].collect())
    assert {p.name for p in (tmp_path / "out" / "cells").glob("sample_id=*")} == {"sample_id=s1", "sample_id=unknown", "sample_id=007", "sample_id=x%2Fy%3Dz %25"}
    assert count_matrix.build(spark, docs, out) == first and cells(spark, out) == want
    assert first["documents_read"] == len(DOCS) and first["cells_written"] == len(want)


def test_count_matrix_of_one_sample(spark, tmp_path):
    """Only the samples asked for are written anew."""
    docs, out = docs_at(spark, tmp_path), f"file://{tmp_path}/out"
    count_matrix.build(spark, docs, out)
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "cells" / "sample_id=s1").glob("*.parquet")}
    docs_at(spark, tmp_path, [*DOCS, (10, "a c", "007")])
    count_matrix.build(spark, docs, out, samples=["007"])
    assert cells(spark, out) == plain([*DOCS, (10, "a c", "007")])[0]
    assert untouched == {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "cells" / "sample_id=s1").glob("*.parquet")}


def test_count_matrix_of_nothing(spark, tmp_path):
    docs, out = docs_at(spark, tmp_path, []), f"file://{tmp_path}/out"
    assert count_matrix.build(spark, docs, out)["cells_written"] == 0
    assert count_matrix.labelled(spark, out).count() == 0


# -- cohort_snapshot ---------------------------------------------------------------


def attempts(n=240):
    """Attempts out of order, some reported twice, some of null keys."""
    out = []
    for k in range(n):
        s, arm, a = f"s{k % 7}", f"L{k % 3}", (k * 37) % n
        status = "success" if (k // 5) % 3 == 0 else "failed"
        out.append((s, arm, a, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", status if k % 31 else None, k * 10 % 170 if k % 17 else None))
        if k % 11 == 0:
            out.append((s, arm, a, f"2024-01-02 00:00:{k % 60:02d}", "success", k))
    return [*out, (None, "L1", 1, None, "success", 1), ("s1", "L1", None, None, "success", 1), ("s9", "L1", 1, None, None, None)]


def table(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, arm string, attempt bigint, seen string, status string, bytes bigint").selectExpr("*", "'x' as bucket", "1 as batch")


def brute(rows, run=2):
    once = {}
    least = lambda v: (v is not None, v if v is not None else 0)
    for s, arm, a, seen, status, size in rows:
        if None not in (s, arm, a):
            rank = ((seen is not None, seen or ""), (status is not None, status or ""), least(size))
            if (s, arm, a) not in once or rank > once[s, arm, a][0]:
                once[s, arm, a] = rank, status == "success", size, seen
    out = {}
    for s, arm in {k[:2] for k in once}:
        mine = sorted((a, v) for (p, q, a), v in once.items() if (p, q) == (s, arm))
        ok = [(v[2], a) for a, v in mine if v[1] and v[2] is not None]
        fails = sum(not v[1] for _, v in mine)
        stop = next((mine[i][0] for i in range(run - 1, len(mine)) if not any(v[1] for _, v in mine[i - run + 1 : i + 1])), None)
        best = min(ok, default=(None, None))
        seen = max((v[3] for _, v in mine if v[3]), default=None)
        out[s, arm] = (len(mine), fails, "done" if fails < len(mine) else "stopped" if stop is not None else "open", *best, stop, seen)
    return out


def standing(spark, out):
    return {(r["sample_id"], r["arm"]): (r["attempts"], r["failures"], r["state"], r["best_bytes"], r["best_attempt"], r["stop_at"], r["last_seen"] and str(r["last_seen"])) for r in cohort_snapshot.read(spark, out).collect()}


@pytest.mark.parametrize("cuts", [(120,), (1, 2, 200), (77, 150)])
def test_growing_input(spark, tmp_path, cuts):
    """The snapshot is that of all attempts so far, however they arrive; only what is new is read."""
    src, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    rows, at = attempts(), 0
    before = spark.sql("SET").collect()
    for to in (*cuts, len(rows)):
        table(spark, rows[at:to]).coalesce(2).write.mode("append").parquet(src)
        got = cohort_snapshot.update(spark, src, out, mark, CONFIG)
        assert got["attempts_read"] == to - at
        assert standing(spark, out) == brute(rows[:to])
        at = to
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    again = cohort_snapshot.update(spark, src, out, mark, CONFIG)
    assert again["batches"] == 0 and files == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert spark.sql("SET").collect() == before


def test_many_small_batches(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    rows = attempts(60)
    table(spark, rows).repartition(5).write.parquet(src)
    got = cohort_snapshot.update(spark, src, out, mark, CONFIG | {"files_per_batch": 1})
    assert got["batches"] == 5 and got["attempts_read"] == len(rows) and standing(spark, out) == brute(rows)
    # The same files again under other names: nothing changes.
    table(spark, rows).repartition(2).write.mode("append").parquet(src)
    assert cohort_snapshot.update(spark, src, out, mark, CONFIG)["attempts_read"] == len(rows)
    assert standing(spark, out) == brute(rows)


def test_single_file(spark, tmp_path):
    """One file among others, of a name that URIs encode: taken once, and again only if another of its name comes."""
    rows = attempts(40)
    table(spark, rows).coalesce(1).write.parquet(f"file://{tmp_path}/w")
    folder = tmp_path / "a folder"
    folder.mkdir()
    next((tmp_path / "w").glob("*.parquet")).rename(folder / "at tempts.parquet")
    table(spark, attempts(90)).coalesce(1).write.parquet(str(folder / "other.parquet"))
    out, mark = (f"file://{tmp_path}/{n}" for n in ("out", "mark"))
    for n in (len(rows), 0):
        assert cohort_snapshot.update(spark, f"{folder}/at tempts.parquet", out, mark, CONFIG)["attempts_read"] == n
        assert standing(spark, out) == brute(rows)


@pytest.mark.parametrize("when", ["before", "after"])
def test_killed_run(spark, tmp_path, monkeypatch, when):
    """A run that ends between its two writes, or before its batch is marked, runs the batch again without loss or repeat."""
    src, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    rows = attempts(90)
    table(spark, rows[:50]).write.parquet(src)
    cohort_snapshot.update(spark, src, out, mark, CONFIG)
    table(spark, rows[50:]).write.mode("append").parquet(src)
    real = cohort_snapshot.snapshot if when == "before" else cohort_snapshot.read

    def fail(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(cohort_snapshot, "snapshot" if when == "before" else "read", fail)
        with pytest.raises(Exception, match="killed"):
            cohort_snapshot.update(spark, src, out, mark, CONFIG)
    assert real in (cohort_snapshot.snapshot, cohort_snapshot.read)
    assert cohort_snapshot.update(spark, src, out, mark, CONFIG)["attempts_read"] == len(rows) - 50
    assert standing(spark, out) == brute(rows)
    assert spark.read.parquet(f"{out}/attempts").count() == len(rows)


def test_registered(spark, small):
    """New folders a call; the session is as it was."""
    before = spark.sql("SET").collect()
    for name, query in catalog.QUERIES.items():
        assert query(spark, small).count() > 0, name
    assert spark.sql("SET").collect() == before
    assert not spark.streams.active


def test_terms_are_counted_where_texts_meet_their_rows(spark):
    """Repeated and null ids are one row; words are shuffled neither before nor after they are counted."""
    docs = spark.createDataFrame([("a", 1, "x y x"), ("a", 1, "x"), ("a", None, "y"), ("a", None, None), ("b", 1, "X")], "sample_id string, doc_id bigint, text string")
    rows = spark.createDataFrame([("a", None, 0), ("a", 1, 1), ("b", 1, 0)], "sample_id string, doc_id bigint, i bigint")
    found = count_matrix.term_counts(docs, rows, "[a-z]+")
    assert {(r["sample_id"], r["i"], r["term"]): r["v"] for r in found.collect()} == {("a", 1, "x"): 3, ("a", 1, "y"): 1, ("a", 0, "y"): 1, ("b", 0, "x"): 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 0 and found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2
