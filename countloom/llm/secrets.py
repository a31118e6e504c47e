"""Secret scans: keyword prefilter, anchored patterns near hits, then checksums.

One Aho-Corasick pass over the ASCII-lower-cased text finds keywords; the pattern
of a kind is matched only at its keywords' places (anchored, never searched).
Long hexadecimal runs have no keyword: a run of 32 covers four places in a row of
every eighth, so every eighth character is tested first. Kinds whose tokens embed
a checksum or a structure are kept only if it holds.

Base kinds (leftmost, not overlapping, per kind): ``assign``, ``access``, ``hex``.
Added kinds: ``github`` and ``npm`` (30 base-62 characters, then their CRC-32 in
six), ``jwt`` (three parts; the first decodes to a JSON object with "alg"),
``pem`` (a private key block whose base64 decodes to a DER sequence of its own
length), ``slack``, ``stripe`` and ``google`` (a fixed prefix and form; these tokens embed
no checksum, so their form is all there is to test).

A match never starts but at a keyword, and keywords of a kind never start at the
same place, so trying keywords from left to right, each from the last match's
end, gives what a search of the whole text gives. No text takes more than linear
time: a pattern's runs are bounded, or end before the next place where it could
start, but for ``jwt``, whose failure rules out all starts in the same run.

Defined cases: a null text is empty; an empty text has no spans and the digest
of the empty string; repeated rows each get their row; an empty table gives no
rows; extra columns are ignored. Texts are scanned whole. Work is row by row.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import pieces

# Keyword lists and patterns of the kinds.
BASE = ("assign", "access", "hex")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
    "eyj": "jwt", "-----begin ": "pem", "xoxb-": "slack", "xoxa-": "slack", "xoxp-": "slack", "xoxr-": "slack", "xoxs-": "slack",
    "sk_live_": "stripe", "rk_live_": "stripe", "aiza": "google",
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"),
    "pem": re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----"),
    "slack": re.compile(r"xox[baprs]-[0-9A-Za-z-]{10,}"),
    "stripe": re.compile(r"[sr]k_live_[0-9A-Za-z]{16,}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
}
PART = re.compile(r"[A-Za-z0-9_-]*")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = (*BASE, "github", "npm", "jwt", "pem", "slack", "stripe", "google")
HEX_LEAST = 32


def _crc62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _json_header(part: str) -> bool:
    try:
        x = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(x, dict) and "alg" in x


def _der(body: str) -> bool:
    """A DER sequence that says its own length."""
    try:
        x = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(x) < 2 or x[0] != 0x30:
        return False
    if x[1] < 0x80:
        return len(x) == 2 + x[1]
    n = x[1] & 0x7F
    return 0 < n <= 8 and len(x) == 2 + n + int.from_bytes(x[2 : 2 + n], "big")


CHECKS = {
    "assign": lambda m: len(m[2]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "github": lambda m: _crc62(m[1]) == m[2],
    "npm": lambda m: _crc62(m[1]) == m[2],
    "jwt": lambda m: _json_header(m[1]),
    "pem": lambda m: _der(m[2]),
}

_machine: list = []
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def _automaton():
    if not _machine:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _machine.append(a)
    return _machine[0]


def _hex_runs(text: str, raw: bytes) -> list[tuple[int, int]]:
    """Maximal runs of 32 and more; raw: the text's bytes, of the same length if it is ASCII."""
    data = np.frombuffer(raw, np.uint8)
    at = _IS_HEX[data[::8]]
    if len(at) < 4:
        return []
    four = np.flatnonzero(at[:-3] & at[1:-2] & at[2:-1] & at[3:])
    runs, upto = [], 0
    for i in (four * 8).tolist():
        if i < upto:
            continue
        a = i
        while a > upto and _IS_HEX[data[a - 1]]:
            a -= 1
        b = _run_end(data, i)
        if b - a >= HEX_LEAST:
            runs.append((a, b))
        upto = b
    if len(raw) != len(text) and runs:  # bytes to code points
        before = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        runs = [(int(before[a]), int(before[b])) for a, b in runs]
    return runs


def _run_end(data: np.ndarray, at: int) -> int:
    step = 64
    while True:
        stop = np.flatnonzero(~_IS_HEX[data[at : at + step]])
        if len(stop):
            return at + int(stop[0])
        if at + step >= len(data):
            return len(data)
        at, step = at + step, step * 2


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then kind as listed in KINDS."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower().decode("utf-8", "surrogatepass")
    upto = dict.fromkeys(PATTERNS, 0)
    found = [(a, b, "hex") for a, b in _hex_runs(text, raw)]
    for end, (n, kind) in _automaton().iter(low):
        start = end - n + 1
        if start < upto[kind]:
            continue
        if kind == "jwt" and text.startswith("eyJ", start) and (dead := _dead_end(text, start)):
            upto[kind] = dead
        elif m := PATTERNS[kind].match(text, start):
            upto[kind] = m.end()
            if kind not in CHECKS or CHECKS[kind](m):
                found.append((start, m.end(), kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _dead_end(text: str, start: int) -> int:
    """Where the run ends that makes all starts of a jwt in it fail, or 0 if a jwt starts here.

    All starts in a run of its characters have the same first dot behind them, and what
    follows that dot: so one failure is the failure of all.
    """
    first = PART.match(text, start).end()
    if text[first : first + 1] != ".":
        return first
    second = PART.match(text, first + 1).end()
    if second == first + 1:
        return first
    return 0 if text[second : second + 1] == "." else second


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_secrets bigint"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document row: counts of the base kinds, their digest, and all spans (code points, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            each = [find_secrets(t) for t in b.column("text").to_pylist()]
            base = [[s for s in x if s[2] in BASE] for x in each]
            count = lambda k: pa.array([sum(s[2] == k for s in x) for x in base], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()), *(count(k) for k in BASE),
                    pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string()), pa.array([_joined(x) for x in each], pa.string()),
                    pa.array([len(x) for x in each], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_secrets"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
