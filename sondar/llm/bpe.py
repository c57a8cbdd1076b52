"""Byte-level BPE encoding of a corpus (problem 7).

Two-tier lookup: a minimal perfect hash over the vocabulary resolves whole
pre-tokens; what it misses is merged with a heap over a linked list of bytes.

Defined results
    null text      -> empty list of ids
    empty text     -> empty list of ids
    special-token strings in a text are ordinary text
    repeated rows  -> one output row for each input row
    empty table    -> empty table with the same schema
    extra columns  -> ignored; only the id and text columns are read
    a word without blanks of any length is merged in O(n log n)

The vocabulary file (tiktoken layout: base64 token and rank on a line) is a
parameter. Its tables are broadcast; their size is that of the vocabulary and
doesn't depend on the data. The plan is one narrow stage: no shuffle.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.session import spread

TOKENIZER_DIR = os.environ.get("SONDAR_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the public pre-token pattern of the 50k byte-level vocabularies.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of the worker's memo of words before it is emptied; bounds its memory.
MEMO_ENTRIES = 200_000
#: Longer words aren't kept in the memo.
MEMO_WORD = 64


class PerfectHash:
    """Minimal perfect hash of byte strings (hash and displace), with the keys kept for verification.

    A key's bucket gives displacements a and b; its slot is (low + a * step + b) mod n. Every
    slot holds exactly one key, so a lookup is one probe and one comparison.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        self.steps = max(1, n - 1)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        bucket = (hashes >> np.uint64(40)) % np.uint64(self.buckets)
        low, step = self._parts(hashes, n)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        self.scale, self.shift = [0] * self.buckets, [0] * self.buckets
        free = np.ones(n, bool)
        slot_of = np.zeros(n, np.int64)
        order_by_size = np.argsort(-sizes, kind="stable")
        single = int((sizes > 1).sum())
        for b in order_by_size[:single]:
            members = order[starts[b] : starts[b + 1]]
            lo, st = low[members], step[members]
            for a in range(64 * n):
                c = a * a % n
                slots = (lo + a * st + c) % n
                if free[slots].all() and len(set(slots.tolist())) == len(slots):
                    break
            else:
                raise ValueError("keys can't be separated; are they distinct?")
            free[slots] = False
            slot_of[members] = slots
            self.scale[b], self.shift[b] = a, c
        left = np.flatnonzero(free).tolist()
        for b, slot in zip(order_by_size[single:].tolist(), left):
            member = order[starts[b]]
            slot_of[member] = slot
            self.shift[b] = int((slot - low[member]) % n)
        self.keys: list[bytes] = [b""] * n
        self.values: list[int] = [0] * n
        for i, s in enumerate(slot_of.tolist()):
            self.keys[s], self.values[s] = keys[i], values[i]

    @staticmethod
    def _parts(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        low = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int64)
        step = (((h >> np.uint64(20)) & np.uint64(0xFFFFF)) % np.uint64(max(1, n - 1)) + np.uint64(1)).astype(np.int64)
        return low, step

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        n, b = self.n, (h >> 40) % self.buckets
        slot = ((h & 0xFFFFFFFF) % n + self.scale[b] * (((h >> 20) & 0xFFFFF) % self.steps + 1) + self.shift[b]) % n
        return self.values[slot] if self.keys[slot] == key else -1


class Encoder:
    """Encodes texts with one vocabulary of ranks."""

    def __init__(self, table: PerfectHash):
        self.table = table
        self.memo: dict[str, tuple[int, ...]] = {}
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(PRETOKEN).findall

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary: lowest rank first, leftmost on ties."""
        get, n = self.table.get, len(data)
        part = [data[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if (rank := get(data[i : i + 2])) >= 0:
                heap.append((rank, i, 2))
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            j = after[i] if part[i] else -1
            if j < 0 or len(part[i]) + len(part[j]) != length:
                continue  # one of the two was merged since
            part[i] += part[j]
            part[j] = b""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := get(part[i] + part[k])) >= 0:
                    heapq.heappush(heap, (rank, i, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (rank := get(part[h] + part[i])) >= 0:
                heapq.heappush(heap, (rank, h, len(part[h]) + len(part[i])))
        return [get(p) for p in part if p]

    def pieces(self, text: str) -> list[int]:
        """Ids of a stretch of text, pre-token by pre-token."""
        out: list[int] = []
        for token in self.find(text):
            ids = self.tokens.get(token)
            out.extend(self.token(token) if ids is None else ids)
        return out

    def token(self, token: str) -> tuple[int, ...]:
        """Ids of a pre-token: the table's, or those of its merged bytes."""
        raw = token.encode()
        whole = self.table.get(raw)
        ids = (whole,) if whole >= 0 else tuple(self.merge(raw))
        if len(token) <= MEMO_WORD:
            if len(self.tokens) >= MEMO_ENTRIES:
                self.tokens.clear()
            self.tokens[token] = ids
        return ids

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a word and the blank before it."""
        ids = tuple(self.pieces(" " + word))
        if len(word) <= MEMO_WORD:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; [] for null.

        A single blank between other characters always starts a pre-token, so the text
        falls apart there into words that are encoded independently of each other. Where
        white space touches white space the whole text goes through the pattern instead.
        """
        if not text:
            return []
        if "  " in text or text[-1].isspace() or text[0] == " " or _SPACE_RUN(text):
            return self.pieces(text)
        words = text.split(" ")
        parts = [tuple(self.pieces(words[0])), *map(self.memo.get, words[1:])]
        if None in parts:
            word = self.word
            parts = [word(w) if ids is None else ids for ids, w in zip(parts, words)]
        return list(chain.from_iterable(parts))

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


#: A blank beside other white space.
_SPACE_RUN = regex.compile(r"\s \s?| [^\S ]").search


def read_ranks(path: str) -> tuple[list[bytes], list[int]]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs]


@lru_cache(maxsize=4)
def perfect_hash(path: str) -> PerfectHash:
    return PerfectHash(*read_ranks(path))


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """The worker's encoder of a broadcast table; kept between the tasks of a worker."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def encode_column(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row of df."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(perfect_hash(path or vocabulary_path()))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared).encode
        for batch in batches:
            lists = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    picked = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    return picked.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")
