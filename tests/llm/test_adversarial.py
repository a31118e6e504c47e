"""Texts and benchmarks made to cost more than their length: time and memory stay in proportion."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from countloom.llm import decontaminate, secrets

MB2 = 2_000_000


def plain_jwt(text):
    """A search of the whole text; quadratic, so for short ones."""
    out = []
    for m in secrets.PATTERNS["jwt"].finditer(text):
        if secrets._json_header(m[1]):
            out.append((m.start(), m.end(), "jwt"))
    return out


def test_jwt_is_a_search():
    rng = random.Random(4)
    good = "eyJhbGciOiJIUzI1NiJ9"
    for _ in range(20_000):
        t = "".join(rng.choice(["eyJ", "eyJ", ".", "a", "-", "_", " ", "é", good, ".b.", "EYJ"]) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.find_secrets(t) if s[2] == "jwt"] == plain_jwt(t)


@pytest.mark.parametrize("unit", ["eyJ", "eyJa.", "eyJa. ", "eyJ.", "token", "token=", "password ", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----A", "xoxb-", "sk_live_", "AKIA", "AIza", "ghp_", "0123456789abcdef", "a0 "])
def test_repeated_units_take_linear_time(unit):
    text = unit * (MB2 // len(unit))
    for t in (text, "eyJa." + text, "token" + " " * MB2 + text[:100]):
        began = time.process_time()
        secrets.find_secrets(t)
        # Linear passes take about a second; a quadratic one takes hours.
        assert time.process_time() - began < 6


def test_hang_of_one_run():
    for t in ("eyJ" * (MB2 // 3), "eyJa." + "eyJ" * (MB2 // 3)):
        began = time.process_time()
        secrets.find_secrets(t)
        assert time.process_time() - began < 1


def _look(items, text):
    raw = decontaminate._block(items, decontaminate.WINDOW)
    with np.load(decontaminate.io.BytesIO(raw)) as z:
        x = {k: z[k] for k in z.files}
    h = decontaminate._Hits(pa.RecordBatch.from_pydict({"text": pa.array([text], pa.large_string())}))
    tracemalloc.start()
    began = time.process_time()
    h.look(x)
    took, (_, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return h, took, peak


def test_shared_prefix_word():
    """Thousands of windows have one rarest word, and a long text is full of it."""
    rng = random.Random(6)
    filler = [f"f{i}" for i in range(40)]
    words = [[rng.choice(filler) for _ in range(12)] for _ in range(6000)]
    items = [(str(i), [w.encode() for w in ["rare", *ws]]) for i, ws in enumerate(words)]
    # Rarest by number of items in the block: fillers come as often, so make them more so.
    items += [(f"x{i}", [f.encode() for f in filler[:13]]) for i in range(7000)]
    text = " ".join(["rare", "f1", "f2"] * 100_000 + ["rare", *words[17], "f3", *words[18][:11], "rare", *words[5999]])
    h, took, peak = _look(items, text)
    assert {"17", "5999"} <= h.items[0] and int(h.inside.sum()) >= 26
    assert took < 20 and peak < 500 << 20


def test_same_word_windows():
    """Every word starts a window that occurs there."""
    h, took, peak = _look([("a", [b"same"] * 13), ("b", [b"same"] * 5), ("c", [b"same"] * 4 + [b"other"])], "same " * 100_000)
    assert h.items[0] == {"a", "b"} and h.inside.all()
    assert took < 20 and peak < 500 << 20


def test_all_sizes_and_places():
    """Windows of every length up to 13 whose rarest word stands anywhere, against plain containment."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(6)]
    items = [(str(i), [rng.choice(vocabulary).encode() for _ in range(rng.randint(1, 16))]) for i in range(60)]
    ws = [rng.choice(vocabulary) for _ in range(3000)]
    h, _, _ = _look(items, " ".join(ws))
    hit, names = set(), set()
    for name, it in items:
        size = min(13, len(it))
        wins = {tuple(w.decode() for w in it[i : i + size]) for i in range(len(it) - size + 1)}
        for i in range(len(ws) - size + 1):
            if tuple(ws[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                names.add(name)
    assert h.items[0] == names and set(np.flatnonzero(h.inside).tolist()) == hit
