"""Token counts by section: offset-mapped attribution.

A document is encoded once, as a whole. Its tokens' spans (from the vocabulary's
byte lengths, summed up) are interval-joined to the spans of its sections, both
sorted, by binary search. A token that lies in one section counts there; one that
crosses a boundary is allocated by an explicit rule:

``first``  to the section of its first byte (the default),
``last``   to the section of its last byte,
``most``   to the section that holds most of its bytes, ties to the earlier,
``split``  to all its sections, by their shares of its bytes.

Sections are the lines of a text (a line keeps its line feed) or, for
``attribute_fields``, columns that are joined by a separator and encoded
together; a separator belongs to the field before it. Counts always sum to the
document's tokens.

Defined cases: null and empty texts have no tokens and no sections; repeated rows
each get their row; an empty table gives no rows; extra columns are ignored. A
text is never cut, however long. Work is row by row: there is no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces, text_buffer

RULES = ("first", "last", "most", "split")
SCHEMA = "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<double>, section_ends array<bigint>"
_open: dict[str, tuple] = {}


def encoding(path: str, pattern: str):
    """(encoding, byte length by id) of a .tiktoken file, once for each worker."""
    if path not in _open:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _open[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _open[path]


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens by section, and how many tokens cross a boundary.

    ends: byte ends of the tokens; bounds: byte ends of the sections. Both ascend
    and both cover the text.
    """
    starts = np.concatenate([[0], ends[:-1]])
    a, b = np.searchsorted(bounds, starts, "right"), np.searchsorted(bounds, ends, "left")
    crossing = np.flatnonzero(a < b)
    if rule == "last":
        a = b
    counts = np.bincount(a, minlength=len(bounds)).astype(np.float64)
    if rule in ("most", "split"):
        for t in crossing:
            inner = np.clip(bounds[a[t] : b[t] + 1], starts[t], ends[t])
            share = np.diff(np.concatenate([[starts[t]], inner]))
            counts[a[t]] -= 1
            if rule == "most":
                counts[a[t] + int(np.argmax(share))] += 1
            else:
                counts[a[t] : b[t] + 1] += share / share.sum()
    return counts, len(crossing)


def _attribute(docs: DataFrame, path: str, pattern: str, rule: str, by_line: bool) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(path, pattern)
        for b in pieces(batches, "text"):
            data, offsets = text_buffer(b.column("text"))
            chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80, dtype=np.int64)])
            feeds = np.flatnonzero(data == 0x0A) + 1
            given = None if by_line else b.column("bounds").to_pylist()
            n_tokens, n_cross, counts, ends_out = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                lo, hi = offsets[i], offsets[i + 1]
                ids = np.array(enc.encode_ordinary(text or ""), np.int64)
                if by_line:
                    inner = feeds[np.searchsorted(feeds, lo, "right") : np.searchsorted(feeds, hi, "left")]
                    bounds = np.concatenate([inner, [hi]]) - lo if hi > lo else np.empty(0, np.int64)
                else:
                    bounds = np.array(given[i], np.int64)
                if len(ids):
                    c, x = allocate(np.cumsum(lengths[ids]), bounds, rule)
                else:
                    c, x = np.zeros(len(bounds)), 0
                n_tokens.append(len(ids))
                n_cross.append(x)
                counts.append(c)
                ends_out.append(chars[bounds + lo] - chars[lo])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([len(c) for c in counts], pa.int64()), pa.array(n_cross, pa.int64()),
                    pa.array(counts, pa.list_(pa.float64())), pa.array(ends_out, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens", "section_ends"],
            )

    return docs.mapInArrow(run, SCHEMA)


def attribute_lines(docs: DataFrame, path: str, pattern: str, rule: str = "first") -> DataFrame:
    """Tokens by line. section_ends are character offsets, exclusive."""
    return _attribute(docs.select("doc_id", "text"), path, pattern, rule, True)


def attribute_fields(docs: DataFrame, fields: list[str], path: str, pattern: str, separator: str = "\n", rule: str = "first") -> DataFrame:
    """Tokens by field of rows whose ``fields`` are joined by ``separator`` (null fields are empty)."""
    texts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if i < len(fields) - 1 else "")) for i, f in enumerate(fields)]
    sizes = [F.octet_length(t).cast("bigint") for t in texts]
    bounds = F.array(*[sum(sizes[1 : i + 1], sizes[0]) for i in range(len(sizes))])
    return _attribute(docs.select("doc_id", F.concat(*texts).alias("text"), bounds.alias("bounds")), path, pattern, rule, False)
