"""Words counted in Arrow batches, and the count matrix of terms that are sent or shuffled."""

import random
import re
from collections import Counter
from functools import partial

import pyarrow as pa
import pytest

from countloom.functions import words
from countloom.operators.skew import most_frequent
from jobs import count_matrix
from tests.test_jobs import DOCS, cells, docs_at, plain


def counted(texts, word="[a-z0-9]+"):
    batch = pa.RecordBatch.from_pydict({"sample_id": ["s"] * len(texts), "i": list(range(len(texts))), "text": texts}).slice(1)
    out = [Counter() for _ in texts]
    for b in words.counter(word)(iter([batch])):
        (r,) = b.to_pylist()
        code, v = (words._unpacked(b.column(c), k).tolist() for c, k in (("codes", "i4"), ("vs", "i8")))
        assert sum(r["sizes"]) == len(code) and r["documents"] == [code.count(k) for k in range(len(r["terms"]))]
        for i, n in zip(r["i"], r["sizes"], strict=True):
            for _ in range(n):
                out[i][r["terms"][code.pop(0)]] += v.pop(0)
    return out[1:]


@pytest.mark.parametrize("step", [1, 40, 1 << 20])
def test_words_are_counted_by_text(monkeypatch, step):
    """Words end with their text; capitals, other scripts and empty texts are as in one text."""
    monkeypatch.setattr(words, "STEP", step)
    rng = random.Random(4)
    texts = ["left out", "ab", "Ab aB", "", "", "é É", "aéa K", "x" * 90, "a-b a", *("".join(rng.choice("abAB 19é_\n") for _ in range(rng.randrange(60))) for _ in range(50)), "end", ""]
    fold = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for word in ("[a-z0-9]+", "[a_]+"):
        assert counted(texts, word) == [Counter(re.findall(word, t.translate(fold))) for t in texts[1:]]


def test_other_expressions_are_left_to_spark():
    assert all(words.letters(w) is None for w in ("[a-z]{2,}", r"\w+", "[^a]+", "[a-z&&[b]]+", "[a-z]", "[A-Z]+", "[é]+"))


@pytest.mark.parametrize("most", [0, 1, 3])
def test_terms_that_are_not_sent(spark, tmp_path, monkeypatch, most):
    """A few terms are sent, or none; the others meet their numbers by a shuffle: the same cells, and in order in their files."""
    monkeypatch.setattr(count_matrix, "most_frequent", partial(most_frequent, most=most))
    docs, out = docs_at(spark, tmp_path), f"file://{tmp_path}/out"
    count_matrix.build(spark, docs, out)
    want, order = plain(DOCS)
    assert cells(spark, out) == want and count_matrix.labelled(spark, out).where("g is null").count() == len(order) - len({c[:2] for c in want})
    for path in (tmp_path / "out" / "cells").rglob("*.parquet"):
        got = [(r["i"], r["g"]) for r in spark.read.parquet(str(path)).collect()]
        assert got == sorted(got)


def test_words_of_two_letters(spark, tmp_path):
    docs, out = docs_at(spark, tmp_path, [(1, "ab a ab", "s"), (2, "AB cd e", "s"), (2, "cd", "s"), (3, "cd", "t")]), f"file://{tmp_path}/out"
    count_matrix.build(spark, docs, out, {"word": "[a-z]{2,}"})
    assert cells(spark, out) == Counter([("s", 0, 1, 0, "ab", 2), ("s", 1, 2, 0, "ab", 1), ("s", 1, 2, 1, "cd", 2), ("t", 0, 3, 1, "cd", 1)])
