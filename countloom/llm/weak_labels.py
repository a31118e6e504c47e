"""Quality classifier from weak labels.

Overlapping heuristics vote junk (1), fine (0) or abstain on every document. Votes
make patterns, of which there are at most 3 ** heuristics however many documents
there are; their counts, one map-side combined aggregation over all documents,
are all that expectation-maximisation needs to estimate how often each heuristic
votes what on junk and on fine documents (votes independent given the class), and
how much junk there is. The posterior of a pattern labels the documents that show
it. A logistic scorer over hashed features is fitted to these soft labels on a
bounded sample (``sample`` distinct texts, by hash; whole texts) and scores every
document.

Features are hashed counts of word shapes (which character classes a word has,
and where), their bigrams, and the heuristics' measures in steps; so the scorer
sees how a text is written, not what it is about, and lengths do not matter.

Defined cases: a null or word-less text is junk by definition (score 1, as it has
nothing to keep); repeated rows each get their row; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NON_SPACE, mix, pieces, shingles, text_buffer, words

BITS = 12

# Measure, at most this is fine, at least this is junk, least words to vote.
HEURISTICS = (
    ("symbols", 0.02, 0.06, 8),  # share of characters that are neither letters, digits nor . ,
    ("capitals", 0.10, 0.30, 5),  # share of characters that are A-Z
    ("digits", 0.10, 0.40, 5),  # share of characters that are 0-9
    ("bare", 0.02, 0.15, 5),  # share of words without a letter or digit
    ("marked", 0.02, 0.20, 5),  # share of words with two marks or more at their end
    ("lines", 0.10, 0.40, 1),  # share of lines that repeat an earlier one
    ("phrases", 0.10, 0.40, 20),  # share of runs of five words that repeat an earlier one
    ("narrow", 0.55, 0.80, 20),  # 1 - distinct words by words, within each 1000 words of the text
)


def _distinct(h: np.ndarray, r: np.ndarray, rows: int) -> np.ndarray:
    """Distinct hashes by row (of 44 bits each, which is plenty within a row)."""
    key = (r.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    key.sort()
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=rows)


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(measures by row and heuristic, words by row, shape of each word, row of each word)."""
    raw, offsets = text_buffer(column)
    w = words(column, NON_SPACE)
    n = np.diff(w.first)
    rows = len(n)
    upper = (raw >= 0x41) & (raw <= 0x5A)
    digit = (raw >= 0x30) & (raw <= 0x39)
    letter = upper | ((raw >= 0x61) & (raw <= 0x7A)) | (raw >= 0x80)
    mild = (raw == 0x2E) | (raw == 0x2C)
    space = ~NON_SPACE[raw]
    symbol = ~(letter | digit | mild | space)
    whole = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
    u, d, a, s, z = (whole(x) for x in (upper, digit, letter | digit, symbol, ~space))
    per_row = lambda c: (c[offsets[1:]] - c[offsets[:-1]]) / np.maximum(1, z[offsets[1:]] - z[offsets[:-1]])
    per_word = lambda c: c[w.end] - c[w.start]
    wu, wd, wa, ws, size = per_word(u), per_word(d), per_word(a), per_word(s), w.end - w.start
    last = lambda k: ~(letter | digit)[np.maximum(w.end - k, w.start)] if len(raw) else np.empty(0, bool)
    tail = (last(1).astype(np.int64) + (last(1) & last(2))) * (size > 1)
    share = lambda x: np.bincount(w.row[x], minlength=rows) / np.maximum(1, n)
    h5, r5 = shingles(w, 5)
    repeats = lambda h, r: 1 - _distinct(h, r, rows) / np.maximum(1, np.bincount(r, minlength=rows))
    phrases = repeats(h5, r5) * (n > 0)
    rank = np.arange(len(w.hash)) - w.first[w.row]
    windows = -(-n // 1000)
    at = (np.cumsum(windows) - windows)[w.row] + rank // 1000
    distinct = np.bincount(np.repeat(np.arange(rows), windows), _distinct(w.hash, at, int(windows.sum())), rows)
    narrow = (1 - distinct / np.maximum(1, n)) * (n > 0)
    # A line's hash sums its words' hashes by place.
    feeds = whole(raw == 0x0A)
    line = feeds[w.start] + w.row
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
    if len(begin):
        place = np.arange(len(line)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(line)]])))
        lh = mix(np.add.reduceat(w.hash * (2 * place.astype(np.uint64) + np.uint64(1)), begin))
        lines = repeats(lh, w.row[begin]) * (n > 0)
    else:
        lines = np.zeros(rows)
    got = np.stack([per_row(s), per_row(u), per_row(d), share(wa == 0), share((tail == 2) & (wa > 0)), lines, phrases, narrow], 1)
    level = lambda x: (x > 0).astype(np.int64) + (x >= np.maximum(size - tail, 1)) * (x > 0)  # noqa: E731  none, some, all
    shape = ((((level(wu) * 3 + level(wd)) * 3 + (wa == 0)) * 3 + np.minimum(ws, 2)) * 3 + tail) * 4 + np.minimum(size // 5, 3)
    return got, n, shape, w.row


def votes(measures: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 junk, 0 fine, 2 abstain."""
    out = np.full(measures.shape, 2, np.int64)
    for j, (_, fine, junk, least) in enumerate(HEURISTICS):
        out[measures[:, j] <= fine, j] = 0
        out[measures[:, j] >= junk, j] = 1
        out[n < least, j] = 2
    return out


def code(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


@dataclass
class LabelModel:
    junk: float
    rate: np.ndarray  # (heuristic, class fine/junk, vote fine/junk) among votes

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of junk; an abstention says nothing."""
        logs = np.concatenate([np.log(self.rate), np.zeros((*self.rate.shape[:2], 1))], 2)
        odds = np.log(self.junk / (1 - self.junk)) + sum(logs[j, 1, v[:, j]] - logs[j, 0, v[:, j]] for j in range(v.shape[1]))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def expectation_maximisation(v: np.ndarray, count: np.ndarray, rounds: int = 100) -> LabelModel:
    """From distinct vote patterns and their counts. Starts where a vote for junk is rare, and rarer on fine documents."""
    k = v.shape[1]
    start = np.array([[0.995, 0.005], [0.6, 0.4]])
    model = LabelModel(0.1, np.tile(start, (k, 1, 1)))
    if not len(v):
        return model
    for _ in range(rounds):
        p = model.posterior(v)
        new = np.empty_like(model.rate)
        for c, weight in enumerate(((1 - p) * count, p * count)):
            for j in range(k):
                seen = np.bincount(v[:, j], weight, 3)[:2] + 10 * start[c]
                new[j, c] = seen / seen.sum()
        junk = float(np.clip((p * count).sum() / count.sum(), 1e-4, 0.5))
        done = np.abs(new - model.rate).max() < 1e-7
        model = LabelModel(junk, new)
        if done:
            break
    return model


def _features(column: pa.Array):
    """Hashed features as (row, id, value) and the measures; values of a row's shapes sum to 1."""
    got, n, shape, row = measure(column)
    ids, rows, values = [], [], []
    place = lambda x, salt: (mix(x.astype(np.uint64) + np.uint64(salt << 32)) >> np.uint64(64 - BITS)).astype(np.int64)
    pair = shape[:-1] * 4096 + shape[1:]
    same = row[:-1] == row[1:] if len(row) else np.empty(0, bool)
    for x, r, salt in ((shape, row, 1), (pair[same], row[:-1][same], 2)):
        key, count = np.unique(r * (1 << BITS) + place(x, salt), return_counts=True)
        rows.append(key >> BITS)
        ids.append(key & ((1 << BITS) - 1))
        values.append(count / np.maximum(1, n[key >> BITS]))
    for j in range(got.shape[1]):
        step = np.digitize(got[:, j], [0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8])
        ids.append(place(step + 64 * j, 3))
        rows.append(np.arange(len(n)))
        values.append(np.ones(len(n)))
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(values), got, n


def vote_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts) over all documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in pieces(batches, "text"):
            got, n, _, _ = measure(b.column("text"))
            for c, k in zip(*np.unique(code(votes(got, n))[n > 0], return_counts=True), strict=True):
                total[int(c)] = total.get(int(c), 0) + int(k)
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(total), pa.int64()), "count": pa.array(list(total.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(run, "code bigint, count bigint").groupBy("code").agg(F.sum("count").alias("count")).orderBy("code").collect()
    codes = np.array([r["code"] for r in rows], np.int64)
    return (codes[:, None] // 3 ** np.arange(len(HEURISTICS))) % 3, np.array([r["count"] for r in rows], np.float64)


@dataclass
class Scorer:
    labels: LabelModel
    weight: np.ndarray


def fit(docs: DataFrame, sample: int = 4000, rounds: int = 300, sample_bytes: int = 16 << 20) -> Scorer:
    """Votes are counted over all documents, the scorer is fitted on about ``sample`` of their texts, of ``sample_bytes`` together.

    A text that occurs several times comes to the driver once, and weighs 1 + ln(times).
    """
    v, count = vote_counts(docs)
    labels = expectation_maximisation(v, count)
    known = docs.select("text").where(F.col("text").isNotNull()).withColumn("_h", F.xxhash64("text"))
    all_ = known.agg(F.approx_count_distinct("_h").alias("n"), F.avg(F.octet_length("text")).alias("b")).first()
    share = min(1.0, sample / max(1, all_["n"]), sample_bytes / max(1.0, all_["n"] * (all_["b"] or 0.0)))
    u = F.shiftrightunsigned(F.xxhash64("_h", F.lit("quality")), 11) / F.lit(float(1 << 53))
    drawn = sorted(known.where(u < share).groupBy("_h").agg(F.first("text").alias("text"), F.count("*").alias("times")).select("text", "times").collect())
    texts = [r["text"] for r in drawn]
    times = 1 + np.log(np.array([r["times"] for r in drawn], np.float64))
    weight = np.zeros((1 << BITS) + 1)
    if texts:
        parts, at = [], 0
        for b in pieces(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])]), "text", 1 << 20):
            rows, ids, values, got, n = _features(b.column("text"))
            p = labels.posterior(votes(got, n))
            p[n == 0] = 1.0
            parts.append(((rows + at).astype(np.int32), ids.astype(np.int16), values.astype(np.float32), p))
            at += b.num_rows
        rows, ids, values, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        g = np.full(len(weight), 1e-3)
        for _ in range(rounds):
            x = np.bincount(rows, values * weight[ids], len(texts)) + weight[-1]
            gap = times * (p - 1 / (1 + np.exp(-np.clip(x, -30, 30))))
            grad = np.concatenate([np.bincount(ids, values * gap[rows], len(weight) - 1), [gap.sum()]]) - 0.01 * weight
            g += grad**2
            weight += 0.5 * grad / np.sqrt(g)
    return Scorer(labels, weight)


SCHEMA = "doc_id bigint, score double, keep boolean, posterior double, votes string"


def _scored(column: pa.Array, model: Scorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids, values, got, n = _features(column)
    x = np.bincount(rows, values * model.weight[ids], len(n)) + model.weight[-1]
    score = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    score[n == 0] = 1.0
    v = votes(got, n)
    p = model.labels.posterior(v)
    p[n == 0] = 1.0
    return score, p, v


def score_quality(docs: DataFrame, model: Scorer) -> DataFrame:
    """score: probability of junk; keep: score below one half; votes: a letter for each heuristic (f, j, -)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            score, p, v = _scored(b.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(score), pa.array(score < 0.5), pa.array(p), pa.array(["".join("fj-"[i] for i in x) for x in v.tolist()], pa.string())],
                ["doc_id", "score", "keep", "posterior", "votes"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Scorer) -> DataFrame:
    """The documents, with all their columns, that the scorer keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield b.filter(pa.array(_scored(b.column("text"), model)[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
