"""Exact duplicates against a plain dictionary."""

import hashlib
from collections import Counter

import pytest

from countloom.llm import catalog, exact_dups


def expected(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return Counter((i, best(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), len(groups)


def check(df, rows):
    got = df.collect()
    want, n_groups = expected(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == n_groups
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])
def test_odd_rows(make, odd, support):
    check(exact_dups.exact_duplicates(make(odd, extra=True), support), odd)


@pytest.mark.parametrize("support", [0.01, 0.25])
def test_hot_text(make, support):
    """A text that a third of all rows hold is decided on the map side, others by a shuffle."""
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 2}", "s") for i in range(900)] + [(None, "hot", "s"), (899, "pair 449", "s")]
    got = exact_dups.exact_duplicates(make(rows), support)
    check(got, rows)
    assert {r["text_sha256"] for r in got.where("frequent").collect()} == {hashlib.sha256(b"hot").hexdigest()}


def test_summary_misses_none(make):
    """All digests above the support are found, at any order of rows, and those below are not taken for frequent."""
    texts = [f"t{i % 7}" if i % 2 else f"single {i}" for i in range(2000)]
    rows = make(texts).repartition(5).select("doc_id", exact_dups.digest().alias("digest"), exact_dups.F.monotonically_increasing_id().alias("row"))
    found = exact_dups.frequent(rows, 0.05).collect()
    assert {bytes(r["digest"]) for r in found} == {hashlib.sha256(f"t{i}".encode()).digest() for i in range(7)}
    assert exact_dups.frequent(rows, 0.2).count() == 0


def test_empty_and_drop(make, odd):
    assert exact_dups.exact_duplicates(make([])).count() == 0
    assert exact_dups.drop_duplicates(make([])).count() == 0
    docs = make(odd, extra=True)
    left = exact_dups.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r["text"] or "" for r in left.collect()) == Counter({t or "" for _, t, _ in odd})
    rows = [(i, "hot" if i % 3 else f"pair {i // 2}", "s") for i in range(300)]
    assert sorted(r["doc_id"] for r in exact_dups.drop_duplicates(make(rows), 0.1).collect()) == sorted({t: i for i, t, _ in rows}.values())


def test_no_python_in_plan(spark, small):
    plan = catalog.op11_exact_dups(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "mapPartitions" not in plan
