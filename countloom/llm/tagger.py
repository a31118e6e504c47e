"""Toxicity by a linear-chain conditional random field.

Tokens (lower-cased words) form chains, cut at line ends and at ``.``, ``!`` or
``?``. Two states; emissions are sums of hashed feature weights (the word, its
prefixes of 3 to 5 bytes, its last 3 bytes, a constant); transitions are a 2 x 2 table. As
only documents carry labels, token labels are made from them: a token of a toxic
document is toxic if its word, or one of its prefixes, stands in toxic training
documents almost only, and in many surroundings. The chain is then fitted to those tokens (AdaGrad on the
exact conditional likelihood), and a logistic layer maps a document's marginals
to its score.

With two states, forward and backward messages are odds, so each step is one
scalar recursion; chains are run side by side, packed by length. Marginals at or
above one half are toxic tokens; neighbours join into offending spans.

The fit is on a bounded sample (``sample`` documents and ``sample_bytes`` of each
label, chosen by hash; whole texts); every document is scored, row by row, without a
shuffle.

Defined cases: null and word-less texts score what the layer gives to no toxic
tokens; null and contradicting labels are not learnt from; a null doc_id counts as the empty string
in the fold; if a label is missing altogether, all scores are the share of the
other; repeated rows each get their row; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import _BYTE, ALNUM, mix, pieces, words

BITS = 18
AFFIXES = (("p", 3), ("p", 4), ("p", 5), ("s", 3))


@dataclass
class Model:
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log scores, from and to
    layer: np.ndarray = field(default_factory=lambda: np.zeros(4))  # bias, best marginal, log of their sum, density
    constant: float | None = None


def _affix(w, kind: str, k: int) -> np.ndarray:
    """Hash of the first or last k bytes of each word; of a word of at most k bytes, a hash of its own."""
    size = w.end - w.start
    out = np.zeros(len(w.start), np.uint64)
    base = w.start if kind == "p" else np.maximum(w.end - k, w.start)
    for d in range(k):
        has = size > d
        out[has] = out[has] * np.uint64(0x9FB21C651E98DF25) + _BYTE[w.data[base[has] + d]]
    return mix(out ^ np.uint64(k * 4 + (kind == "p")))


def features(w) -> np.ndarray:
    """Hashed feature ids, a row for each word."""
    # The last column is the same for all: how likely a token is to be toxic before anything is known of it.
    cols = [w.hash, *(_affix(w, kind, k) for kind, k in AFFIXES), np.zeros(len(w.hash), np.uint64)]
    return np.stack([(mix(c ^ np.uint64(0x1000193 * (i + 1))) >> np.uint64(64 - BITS)).astype(np.int32) for i, c in enumerate(cols)], 1)


def chains(w) -> np.ndarray:
    """First words of the chains."""
    if not len(w.start):
        return np.empty(0, np.int64)
    stop = np.isin(w.data, np.frombuffer(b".!?\n", np.uint8))
    upto = np.concatenate([[0], np.cumsum(stop)])
    new = (upto[w.start[1:]] > upto[w.end[:-1]]) | (w.row[1:] != w.row[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


class Packed:
    """Chains side by side: step t holds the t-th word of every chain that long."""

    def __init__(self, first: np.ndarray, total: int):
        size = np.diff(np.concatenate([first, [total]]))
        order = np.argsort(-size, kind="stable")
        self.size, begin = size[order], first[order]
        most = int(self.size[0]) if len(size) else 0
        self.live = np.searchsorted(-self.size, -np.arange(most), "left")  # chains longer than t
        self.at = np.concatenate([[0], np.cumsum(self.live)]).astype(np.int64)
        rank = np.empty(total, np.int64)
        chain = np.repeat(np.arange(len(size)), self.size)
        step = np.arange(total) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        word = np.repeat(begin, self.size) + step
        rank[word] = self.at[step] + chain
        self.rank = rank  # place of each word in packed order


def odds(packed: Packed, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds, backward odds and emission odds in packed order."""
    e = np.empty(len(emit))
    e[packed.rank] = np.exp(np.clip(emit, -30, 30))
    m = np.exp(move)
    f, b = np.empty_like(e), np.ones_like(e)
    at, live = packed.at, packed.live
    for t in range(len(live)):
        here = slice(at[t], at[t] + live[t])
        if t == 0:
            f[here] = e[here]
        else:
            r = f[at[t - 1] : at[t - 1] + live[t]]
            f[here] = e[here] * ((m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0]))
    for t in range(len(live) - 2, -1, -1):
        n = live[t + 1]
        x = e[at[t + 1] : at[t + 1] + n] * b[at[t + 1] : at[t + 1] + n]
        b[at[t] : at[t] + n] = (m[1, 0] + x * m[1, 1]) / (m[0, 0] + x * m[0, 1])
    return f, b, e


def marginals(w, model: Model) -> np.ndarray:
    """Probability of each word being toxic."""
    if not len(w.hash):
        return np.empty(0)
    emit = model.weight[features(w)].sum(1, dtype=np.float64)
    packed = Packed(chains(w), len(emit))
    f, b, _ = odds(packed, emit, model.move)
    o = (f * b)[packed.rank]
    return o / (1 + o)


def _pairs(packed: Packed, f: np.ndarray, b: np.ndarray, e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected transitions, summed over all chains."""
    m, out = np.exp(move), np.zeros((2, 2))
    for t in range(1, len(packed.live)):
        n = packed.live[t]
        r = f[packed.at[t - 1] : packed.at[t - 1] + n]
        x = e[packed.at[t] : packed.at[t] + n] * b[packed.at[t] : packed.at[t] + n]
        z = m[0, 0] + m[0, 1] * x + r * (m[1, 0] + m[1, 1] * x)
        out += np.array([[(m[0, 0] / z).sum(), (m[0, 1] * x / z).sum()], [(m[1, 0] * r / z).sum(), (m[1, 1] * r * x / z).sum()]])
    return out


def document_features(w, p: np.ndarray, rows: int) -> np.ndarray:
    best, total = np.zeros(rows), np.bincount(w.row, np.where(p >= 0.5, p, 0), rows)
    np.maximum.at(best, w.row, p)
    n = np.diff(w.first)
    return np.stack([np.ones(rows), best, np.log1p(total), 10 * np.minimum(0.1, total / np.maximum(n, 1))], 1)


def _token_labels(w, feats: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for words, or words with prefixes, that toxic documents have far beyond chance.

    What counts is in how many different surroundings (word before and after) a key
    stands in toxic and in other documents: copies of one document repeat theirs, so
    words that merely come along in copies count once. A key is toxic if so many
    surroundings would hardly all be toxic by chance for any key (Bonferroni over
    all keys at one hundredth), with at most one other in twenty.
    """
    around = mix(np.concatenate([[np.uint64(1)], w.hash[:-1]]) * np.uint64(3) + np.concatenate([w.hash[1:], [np.uint64(1)]]))
    bad = toxic[w.row]
    label = np.zeros(len(w.hash), bool)
    for c in range(4):  # the word, then prefixes
        key = feats[:, c].astype(np.int64)
        _, first = np.unique(mix(around ^ (key.astype(np.uint64) << np.uint64(40))), return_index=True)
        hit, all_ = np.bincount(key[first], bad[first], 1 << BITS), np.bincount(key[first], minlength=1 << BITS)
        share = min(0.99, max(1e-6, float(bad.mean())))
        least = max(4, int(np.ceil(np.log(0.01 / max(1, (all_ > 0).sum())) / np.log(share))))
        label |= ((hit >= least) & (hit > 20 * (all_ - hit)))[key]
    return label & bad


def fit(texts: list[str | None], toxic: np.ndarray, epochs: int = 4, batch: int = 400, rate: float = 0.3, ridge: float = 1e-6, seed: int = 7) -> Model:
    model, toxic = Model(), np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        model.constant = float(toxic.mean()) if len(toxic) else 0.0
        return model
    w = words(pa.array(texts, pa.large_string()), ALNUM)
    feats = features(w)
    label = _token_labels(w, feats, toxic)
    g_w, g_m = np.full(1 << BITS, 1e-3), np.full((2, 2), 1e-3)
    model.weight = np.zeros(1 << BITS)
    order = np.random.default_rng(seed)
    starts = chains(w)
    size = np.diff(np.concatenate([starts, [len(w.hash)]]))
    chain_of = np.repeat(np.arange(len(starts)), size)
    docs = np.arange(len(texts))
    for _ in range(epochs):
        order.shuffle(docs)
        for a in range(0, len(docs), batch):
            own = np.zeros(len(texts), bool)
            own[docs[a : a + batch]] = True
            at = np.flatnonzero(own[w.row])
            if not len(at):
                continue
            ff, y = feats[at], label[at].astype(np.float64)
            first = np.flatnonzero(np.concatenate([[True], np.diff(chain_of[at]) != 0]))
            packed = Packed(first, len(at))
            f, b, e = odds(packed, model.weight[ff].sum(1), model.move)
            o = (f * b)[packed.rank]
            gap = y - o / (1 + o)
            grad = np.bincount(ff.ravel(), np.repeat(gap, ff.shape[1]), 1 << BITS) - ridge * len(at) * model.weight
            inner = np.ones(len(at), bool)
            inner[first] = False
            prev, this = y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)
            seen = np.bincount(prev * 2 + this, minlength=4).reshape(2, 2)
            step = (seen - _pairs(packed, f, b, e, model.move)) / max(1, len(docs) / batch)
            g_w += grad**2
            g_m += step**2
            model.weight += rate * grad / np.sqrt(g_w)
            model.move += rate * step / np.sqrt(g_m)
    model.weight = model.weight.astype(np.float32)
    x = document_features(w, marginals(w, model), len(texts))
    y = toxic.astype(np.float64)
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (~toxic).mean())
    v = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's iterations with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * v
        v += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(v)), grad)
    model.layer = v
    return model


def fold(doc_id: str = "doc_id", of: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def _uniform(*columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit("toxic")), 11) / F.lit(float(1 << 53))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = 2000, sample_bytes: int = 16 << 20) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of about ``sample`` labelled documents of each label, by hash, out of the held-out fold.

    Rows of one id and one text count once, and what comes to the driver is bounded by
    about twice ``sample`` texts and ``sample_bytes`` bytes a label, however often ids
    repeat. Ids whose labels disagree are not learnt from.
    """
    known = labels.where((fold() != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    by_label = lambda of: F.when(F.col("toxic") == 1, F.lit(of(1))).otherwise(F.lit(of(0)))
    chosen = known.where(_uniform("doc_id") < by_label(lambda t: sample / max(1, n.get(t, 0))))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_h", F.xxhash64("text"))
    found = {r["toxic"]: r for r in rows.select("doc_id", "_h", "toxic", F.octet_length("text").alias("b")).distinct().groupBy("toxic").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()}
    share = lambda t: min(1.0, 2 * sample / found[t]["n"], sample_bytes / max(1, found[t]["b"] or 0)) if t in found else 1.0
    got = rows.where(_uniform("doc_id", "_h") < by_label(share)).dropDuplicates(["doc_id", "_h"]).select("doc_id", "text", "toxic").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"] or "", r["toxic"]))
    return [r["text"] for r in got], np.array([r["toxic"] for r in got], bool)


SCHEMA = "doc_id bigint, score double, predicted int, n_toxic bigint, spans array<struct<start:bigint,end:bigint>>"


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row; spans are character offsets, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = words(b.column("text"), ALNUM)
            p = marginals(w, model) if model.constant is None else np.zeros(len(w.hash))
            x = document_features(w, p, b.num_rows)
            score = 1 / (1 + np.exp(-np.clip(x @ model.layer, -30, 30))) if model.constant is None else np.full(b.num_rows, model.constant)
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            hot = np.flatnonzero(p >= 0.5)
            if len(hot):
                chars = np.concatenate([[0], np.cumsum(w.data & 0xC0 != 0x80, dtype=np.int64)])
                base = _row_starts(b, chars)
                for g in np.split(hot, np.flatnonzero((np.diff(hot) != 1) | np.diff(w.row[hot]).astype(bool)) + 1):
                    r = w.row[g[0]]
                    spans[r].append({"start": int(chars[w.start[g[0]]] - base[r]), "end": int(chars[w.end[g[-1]]] - base[r])})
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.bincount(w.row[hot], minlength=b.num_rows), pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "score", "predicted", "n_toxic", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _row_starts(b: pa.RecordBatch, chars: np.ndarray) -> np.ndarray:
    from .words import text_buffer

    return chars[text_buffer(b.column("text"))[1][:-1]]
