"""Byte-level BPE encoding and decoding in two tiers.

A pre-token that is in the vocabulary is resolved whole by a minimal perfect hash (hash, displace and compare: one slot for
each key, no empty ones). Any other goes through a heap of mergeable neighbours over a linked list of its bytes, lowest rank
first, leftmost on ties. Results of pre-tokens are kept in a bounded memo.

Defined results: null and empty texts have no tokens; their digests are those of the empty string. Repeated rows and null
ids are encoded as any others. Extra input columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_worker, small

MEMO = 250_000
#: Characters of a pre-token up to which it is remembered.
LONGEST = 64
#: Keys a bucket of the perfect hash, on average.
LOAD = 4
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by id; ids are dense from 0."""
    found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in open(path, "rb") if line.strip())}
    return [found[i] for i in range(len(found))]


def _slot(h: int, d: int, n: int) -> int:
    x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xFF51AFD7ED558CCD) & _MASK
    return (x >> 33) % n


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: each bucket stores the displacement that sends its keys to free slots;
    a bucket of one key stores its slot itself, as a negative number."""

    def __init__(self, keys: list[bytes], tables: tuple[list[int], list[int]] | None = None) -> None:
        self.keys, n = keys, len(keys)
        self.n_buckets = max(1, n // LOAD)
        if tables:
            self.moves, self.owner = tables
            return
        buckets = defaultdict(list)
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self.n_buckets].append((h, i))
        moves, owner, free = np.zeros(self.n_buckets, np.int64), np.full(n, -1, np.int64), set(range(n))
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                at = free.pop()
                owner[at], moves[b] = members[0][1], -at - 1
                continue
            d = 0
            while len(slots := {_slot(h, d, n) for h, _ in members} & free) < len(members):
                d += 1
            for h, i in members:
                owner[_slot(h, d, n)] = i
            free -= slots
            moves[b] = d
        self.moves, self.owner = moves.tolist(), owner.tolist()

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.moves[h % self.n_buckets]
        i = self.owner[-d - 1 if d < 0 else _slot(h, d, len(self.keys))]
        return i if self.keys[i] == key else -1


class Splitter:
    """Pre-tokens of a text as public_tokenizers.PATTERN has them. The standard library's classes agree with the Unicode
    ones but for a few characters and the underscore; texts with such characters take the slower engine."""

    def __init__(self) -> None:
        self.exact = regex.compile(public_tokenizers.PATTERN)
        self.odd = {"\x1c", "\x1d", "\x1e", "\x1f"}
        self.odd.update(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
        shape = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?%s+|\s+(?!\S)|\s+"
        self.plain, self.under = re.compile(shape % r"[^\s\w]"), re.compile(shape % r"(?:[^\s\w]|_)")

    def __call__(self, text: str) -> list[str]:
        if not self.odd.isdisjoint(text):
            return self.exact.findall(text)
        return (self.under if "_" in text else self.plain).findall(text)


class Encoder:
    def __init__(self, vocabulary: list[bytes], whole: PerfectHash) -> None:
        self.vocabulary, self.whole, self.split = vocabulary, whole, Splitter()
        ids = {t: i for i, t in enumerate(vocabulary)}
        self.of_byte = [ids.get(bytes([b]), -1) for b in range(256)]
        #: (left id, right id) as one integer: id of the two joined
        self.joined = {(ids[t[:c]] << 32) | ids[t[c:]]: i for t, i in ids.items() for c in range(1, len(t)) if t[:c] in ids and t[c:] in ids}
        self.memo: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary."""
        part, n, joined = [self.of_byte[b] for b in raw], len(raw), self.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = (part[i] << 32) | part[i + 1]
            if (rank := joined.get(pair)) is not None:
                heap.append((rank, i, pair))
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or part[i] < 0 or (part[i] << 32) | part[j] != pair:
                continue
            part[i], part[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = (rank << 32) | part[k]
                if (to := joined.get(pair)) is not None:
                    heapq.heappush(heap, (to, i, pair))
            h = before[i]
            if h >= 0:
                pair = (part[h] << 32) | rank
                if (to := joined.get(pair)) is not None:
                    heapq.heappush(heap, (to, h, pair))
        return [p for p in part if p >= 0]

    def pre_token(self, token: str) -> bytes:
        raw = token.encode("utf-8")
        whole = self.whole.get(raw)
        return np.array([whole] if whole >= 0 else self.merge(raw), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        memo, tokens = self.memo, self.split(text)
        try:
            return b"".join([memo[t] for t in tokens])
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            # long pre-tokens hardly come back, and would make the memo as large as the texts
            own = {}
            for t in set(tokens):
                if t not in memo:
                    (memo if len(t) <= LONGEST else own)[t] = self.pre_token(t)
            return b"".join([memo[t] if t in memo else own[t] for t in tokens])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and tokens (array of ids) if with_ids."""
    spark = docs.sparkSession
    whole = PerfectHash(read_ranks(path))
    tables = spark.sparkContext.broadcast((whole.keys, whole.moves, whole.owner))  # as large as the vocabulary, not the data

    def run(batches):
        keys, moves, owner = tables.value
        encoder = in_worker("byte_bpe", path, lambda: Encoder(keys, PerfectHash(keys, (moves, owner))))
        for b in small(batches):
            ids = [encoder.encode(t) for t in b.column("text").to_pylist()]
            out = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                names.append("tokens")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, schema)
