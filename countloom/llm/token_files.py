"""Token ids as raw binary shards with a minimal perfect hash index over document keys.

Layout under one folder, for shards in ascending key order:

``NAME.ids``  the ids of all documents of the shard, little-endian, 2 bytes each
              where the vocabulary allows, else 4; each document ends with ``end_id``.
``NAME.idx``  an .npz, the hash index: one bit array per level, and by slot a 32-bit
              fingerprint, the offset (ids before it in the shard) and length of the
              key's first document and how many it has. Further documents of a key
              and those without one are listed apart. No key is stored.
``manifest.json``  width, end_id and by shard its name, key range, rows, ids and the ids
              of all shards before it.

The index (BBHash: Limasset, Rizk, Chikhi and Peterlongo, 2017) keeps about 3.5
bits a key: on each level a key that is alone at its place sets that bit, others
go on to the next level; a key's slot is the rank of its bit. A lookup probes a
few bits, compares the fingerprint, and reads the ids at the slot's offset. That is
how documents are read back, one by one or all of them: there is no other way from
a key to its ids. A key that was never written passes for another one in 2**32.

Documents are range-partitioned and sorted by key, ties by a hash of the text and
the input partition, so equal rows do not all meet in one task. Each task streams
one shard to files of its attempt's own name; the manifest, which the driver writes
last from one line a shard, says which attempt counts.

Encoding goes through the tokenizers library, in pieces cut at ASCII white space
and cached: the tokenizer the engine is meant for drops white space and never joins
across it, so pieces give the ids of the whole text. A tokenizer of another
normaliser or pre-tokenizer gets whole texts.

Defined cases: a null text is empty and has just the end id; repeated keys keep a
document each, adjacent, ordered by a hash of their texts; null keys come first and
are read by their list; keys that were not written give no rows; an empty table
gives no shards; extra columns are ignored.
"""

from __future__ import annotations

import io
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import attempt_name, fresh_path, open_fs, read_bytes, write_bytes
from .words import keep, mix, pieces

# The normaliser and pre-tokenizer of which it is known that pieces give the ids of whole texts.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

_PIECE = re.compile(r"[^ \t-\r]+")
_CONTROLS = re.compile(r"[\x1c-\x1f]")
_CACHE_MOST = 800_000
_encoders: dict[tuple[str, int], PieceEncoder] = {}


def _byte_chars() -> dict[int, str]:
    """How byte-level models write bytes: printable ones as themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


class PieceEncoder:
    """Ids of texts as bytes, through a bounded cache of white-space-delimited pieces.

    Lower-casing ASCII first changes nothing for a tokenizer that lower-cases (texts
    with a special token's opening are left as they are). A full stop or comma after
    a word of letters is a word of its own, so it need not be learnt anew, and a
    lower-case Latin word goes to the library's model directly.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if width == 2 else "I"
        self.cache: dict[str, bytes] = {}
        form = json.loads(self.tokenizer.to_str())
        splits = (form.get("normalizer") or {}).get("normalizers") == _NORMALIZER and (form.get("pre_tokenizer") or {}).get("pretokenizers") == [_SPLIT, _BYTES]
        self.pieced = splits and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in form["added_tokens"])
        if not self.pieced:
            return
        self.marks = {m: self._whole([m])[0] for m in ".,"}
        self.lowers = self._whole(["Aa"]) == self._whole(["aa"])
        tries = ["a", "the", "été", "übergröße", "ñandú", "ærø", "œuvre", "ÿ"]
        self.direct = self.lowers and [self._word(t) for t in tries] == self._whole(tries)

    @classmethod
    def of(cls, path: str, width: int) -> PieceEncoder:
        """One for each worker process."""
        keep("tokens", _encoders.clear)
        if (path, width) not in _encoders:
            _encoders[path, width] = cls(path, width)
        return _encoders[path, width]

    def _word(self, word: str) -> bytes:
        """Of one lower-case Latin word, by the library's model alone: nothing is left to normalise or to cut."""
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()

    def _whole(self, some: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        cache = self.cache
        marked = [p for p in new if p[-1] in self.marks and p[:-1].isalpha() and p[:-1].lower().isalpha()]
        later = set(marked)
        some = [p for p in new if p not in later] + [p for p in {p[:-1] for p in marked}.difference(new) if p not in cache]
        if self.direct:
            plain = [p for p in some if p.isalpha() and (p.isascii() or max(p) <= "\u024f") and p == p.lower()]
            cache.update(zip(plain, map(self._word, plain), strict=True))
            some = set(some).difference(plain)
        some = list(some)
        for at in range(0, len(some), 5000):
            part = some[at : at + 5000]
            cache.update(zip(part, self._whole(part), strict=True))
        for p in marked:
            cache[p] = cache[p[:-1]] + self.marks[p[-1]]

    def _pieces(self, text: str) -> list[str]:
        if self.lowers and "<|" not in text:
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        # str.split() and the tokenizer differ in these four characters only.
        return _PIECE.findall(text) if _CONTROLS.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.pieced:
            return self._whole([t or "" for t in texts])
        split = [self._pieces(t or "") for t in texts]
        if len(self.cache) > _CACHE_MOST:
            self.cache.clear()
        cache = self.cache
        self._learn(set().union(*split).difference(cache))
        return [b"".join(map(cache.__getitem__, ps)) for ps in split]


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


class PerfectHash:
    """Keys (distinct int64) to slots 0..n-1, without the keys."""

    GAMMA = 2.0

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits  # bytes of each level, least significant bit first
        ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(b), dtype=np.int64)]) for b in bits]
        self.before = np.concatenate([[0], np.cumsum([o[-1] for o in ones])]).astype(np.int64)
        self.rank = ones

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.full(1, level * 2 + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return ((h >> np.uint64(11)).astype(np.float64) * (size / float(1 << 53))).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, level = [], 0
        while len(keys):
            size = max(64, int(len(keys) * cls.GAMMA + 7) // 8 * 8)
            at = cls._place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
            level += 1
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots; a key that was not built in gets some slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, b in enumerate(self.bits):
            at = self._place(keys[left], level, len(b) * 8)
            byte, bit = b[at >> 3], (at & 7).astype(np.uint8)
            set_ = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[left[set_]] = (self.before[level] + self.rank[level][at >> 3] + below)[set_]
            left = left[~set_]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xA5A5F00DA5A5F00D)) >> np.uint64(32)).astype(np.uint32)


def _index(keys: np.ndarray, valid: np.ndarray, lengths: np.ndarray) -> bytes:
    """The index of a shard's documents, which ascend by key, those without one first."""
    start = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)[: len(lengths)]
    rows = np.flatnonzero(valid)
    unique, at, n = np.unique(keys[rows], return_index=True, return_counts=True)
    ph = PerfectHash.build(unique)
    slot = ph.slots(unique)
    by = {c: np.empty(len(unique), d) for c, d in (("mark", np.uint32), ("start", np.int64), ("length", np.int64), ("count", np.int64))}
    by["mark"][slot], by["start"][slot], by["length"][slot], by["count"][slot] = fingerprint(unique), start[rows[at]], lengths[rows[at]], n
    again = np.ones(len(rows), bool)
    again[at] = False
    owner = np.repeat(slot, n)[again]
    order = np.argsort(owner, kind="stable")
    more, none = rows[again][order], np.flatnonzero(~valid)
    out = io.BytesIO()
    np.savez(
        out, **by, more_slot=owner[order], more_start=start[more], more_length=lengths[more], none_start=start[none], none_length=lengths[none],
        **{f"level{i}": b for i, b in enumerate(ph.bits)},
    )
    return out.getvalue()


class Index:
    """A shard's index."""

    def __init__(self, raw: bytes):
        with np.load(io.BytesIO(raw)) as z:
            self.by = {k: z[k] for k in z.files}
        self.hash = PerfectHash([self.by[f"level{i}"] for i in range(sum(k.startswith("level") for k in self.by))])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``keys``, offset, length) of the documents of keys that are here."""
        x = self.by
        slot = self.hash.slots(keys)
        at = np.flatnonzero(slot >= 0)
        at = at[x["mark"][slot[at]] == fingerprint(keys[at])]
        slot = slot[at]
        more = x["count"][slot] - 1
        lo = np.searchsorted(x["more_slot"], slot)
        rest = np.repeat(lo, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        return np.concatenate([at, np.repeat(at, more)]), np.concatenate([x["start"][slot], x["more_start"][rest]]), np.concatenate([x["length"][slot], x["more_length"][rest]])


def _read_ids(uri: str, start: np.ndarray, length: np.ndarray, width: int, most: int = 8 << 20) -> Iterator[np.ndarray]:
    """The ids at ascending offsets, read in runs of at most ``most`` bytes, one document at least."""
    where, path = open_fs(uri)
    end = start + length
    with where.open_input_file(path) as f:
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + most // width, "right")))
            f.seek(int(start[a]) * width)
            raw = np.frombuffer(f.read(int(end[b - 1] - start[a]) * width), f"<u{width}")
            for i in range(a, b):
                yield raw[start[i] - start[a] : end[i] - start[a]]
            a = b


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, base: str | None = None, shard_mb: int = 64) -> str:
    """Encode and write all documents; returns the folder's URI. ``tokenizer_path`` is read on the executors."""
    spark = docs.sparkSession
    base, width = base or fresh_path(spark, "tokens"), id_width(tokenizer_path)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (shard_mb << 20)) if size < 1 << 60 else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dtype = PieceEncoder.of(tokenizer_path, width), np.dtype(f"<u{width}")
        end = np.array([end_id], dtype).tobytes()
        shard = TaskContext.get().partitionId()
        name = attempt_name(shard)
        keys, valid, lengths = [], [], []
        where, path = open_fs(f"{base}/{name}.ids")
        out = None
        for b in pieces(batches, "text", owner="tokens"):
            if out is None:
                where.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = where.open_output_stream(path)
            encoded = [x + end for x in encoder.encode(b.column("text").to_pylist())]
            key = b.column("doc_id").cast(pa.int64())
            keys.append(key.fill_null(0).to_numpy(zero_copy_only=False))
            valid.append(key.is_valid().to_numpy(zero_copy_only=False))
            lengths.append(np.array([len(x) // width for x in encoded], np.int64))
            out.write(b"".join(encoded))
        if out is None:
            return
        out.close()
        k, v, n = (np.concatenate(x) for x in (keys, valid, lengths))
        write_bytes(f"{base}/{name}.idx", _index(k, v, n))
        named = k[v]
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "rows": [len(k)], "ids": [int(n.sum())], "nameless": [int((~v).sum())], "lo": [int(named[0]) if len(named) else None], "hi": [int(named[-1]) if len(named) else None]})

    key = F.col("doc_id").asc_nulls_first()
    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text")).withColumn("_part", F.spark_partition_id())
    ranged = kept.repartitionByRange(parts, key, "_tie", "_part").sortWithinPartitions(key, "_tie")
    shards = sorted(ranged.mapInArrow(run, "shard bigint, name string, rows bigint, ids bigint, nameless bigint, lo bigint, hi bigint").collect())
    start, listed = 0, []
    for s in shards:
        listed.append(s.asDict() | {"start": start})
        start += s["ids"]
    write_bytes(f"{base}/manifest.json", json.dumps({"width": width, "end_id": end_id, "shards": listed}).encode())
    return base


class TokenFiles:
    """Keyed access: the ids of a document's rows, by key."""

    def __init__(self, base: str):
        self.base, self.manifest = base, json.loads(read_bytes(f"{base}/manifest.json"))
        self.named = [s for s in self.manifest["shards"] if s["hi"] is not None]
        self.lo, self.hi = (np.array([s[c] for s in self.named], np.int64) for c in ("lo", "hi"))
        self.open: dict[str, Index] = {}

    def shards(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, place in ``named``) of the shards whose range holds a key."""
        first, n = np.searchsorted(self.hi, keys, "left"), np.searchsorted(self.lo, keys, "right")
        n = np.maximum(n - first, 0)
        return np.repeat(np.arange(len(keys)), n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())

    def index(self, name: str) -> Index:
        if name not in self.open:
            self.open[name] = Index(read_bytes(f"{self.base}/{name}.idx"))
        return self.open[name]

    def get(self, key: int) -> list[np.ndarray]:
        found, one = [], np.array([key], np.int64)
        for at in self.shards(one)[1]:
            name = self.named[at]["name"]
            _, start, length = self.index(name).find(one)
            found += _read_ids(f"{self.base}/{name}.ids", start, length, self.manifest["width"])
        return found


def read_token_files(spark: SparkSession, base: str, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of the ids in ``keys``, through the index; null asks for those without one.

    Keys are sent to the shards in whose range they lie, and each shard looks its own up.
    """
    files = TokenFiles(base)
    width, shards = files.manifest["width"], files.manifest["shards"]
    start_of = {s["name"]: s["start"] for s in shards}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column("doc_id").drop_null().to_numpy(zero_copy_only=False)
            key, shard = files.shards(asked)
            nameless = [s["name"] for s in shards if s["nameless"]] if b.column("doc_id").null_count else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([*(files.named[i]["name"] for i in shard.tolist()), *nameless], pa.string()), pa.concat_arrays([pa.array(asked[key], pa.int64()), pa.nulls(len(nameless), pa.int64())])], ["name", "doc_id"]
            )

    def look(group: pa.Table) -> pa.Table:
        name, asked = group.column("name")[0].as_py(), group.column("doc_id").combine_chunks()
        index = Index(read_bytes(f"{base}/{name}.idx"))
        own = asked.drop_null().to_numpy(zero_copy_only=False)
        at, start, length = index.find(own)
        key, known = own[at], np.ones(len(at), bool)
        if asked.null_count:
            x = index.by
            start, length = np.concatenate([x["none_start"], start]), np.concatenate([x["none_length"], length])
            key, known = np.concatenate([np.zeros(len(x["none_start"]), np.int64), key]), np.concatenate([np.zeros(len(x["none_start"]), bool), known])
        order = np.argsort(start, kind="stable")
        key, known, start, length = key[order], known[order], start[order], length[order]
        crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for ids in _read_ids(f"{base}/{name}.ids", start, length, width)), np.int64, len(start))
        return pa.table([pa.array(key, pa.int64(), mask=~known), pa.array(start + start_of[name]), pa.array(length), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    asked = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return asked.mapInArrow(route, "name string, doc_id bigint").groupBy("name").applyInArrow(look, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
