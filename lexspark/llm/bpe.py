"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token starts as a doubly linked list of bytes.  Every mergeable neighbour pair is filed in the
bucket of its merge rank; a bucket is a heap of list positions.  Which buckets hold anything is recorded in
a bitmap of 64-bit words with two summary levels above it, so the lowest rank is found with three
find-first-set steps whatever the length of the pre-token.  A position popped from a bucket is *stale* when
its pair was changed by a neighbouring merge since it was filed; stale positions are skipped.  Work per
pre-token is O(n log n), against O(n^2) for a rescan of all pairs after each merge.

Cases: null text counts as empty; empty text gives no ids; repeated rows give repeated results; other
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Distinct pre-tokens a worker remembers before it starts afresh: bounds its memory, not what is encoded.
CACHE_ENTRIES = 1_000_000
#: Pre-tokens longer than this many bytes are not remembered.
CACHE_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a ``.tiktoken`` file (base64 token, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions per rank, below a three-level bitmap of the ranks in use."""

    __slots__ = ("buckets", "level0", "level1", "level2")

    def __init__(self, n_ranks: int):
        words = (n_ranks >> 6) + 1
        self.buckets: dict[int, list[int]] = {}
        self.level0 = [0] * words
        self.level1 = [0] * ((words >> 6) + 1)
        self.level2 = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.level0[word] |= 1 << (rank & 63)
        self.level1[word >> 6] |= 1 << (word & 63)
        self.level2 |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int]:
        """The lowest rank in use and its leftmost position; the queue must hold something (``level2`` is not 0)."""
        top = (self.level2 & -self.level2).bit_length() - 1
        mid = self.level1[top]
        word = top << 6 | (mid & -mid).bit_length() - 1
        low = self.level0[word]
        rank = word << 6 | (low & -low).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            position = heappop(bucket)
        else:
            position = bucket[0]
            del self.buckets[rank]
            self.level0[word] = low & (low - 1)
            if not self.level0[word]:
                self.level1[top] = mid & (mid - 1)
                if not self.level1[top]:
                    self.level2 &= self.level2 - 1
        return rank, position


class ByteBPE:
    """Encoder and decoder for one rank file and one pre-tokenisation pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for tok, rank in ranks.items():
            self.tokens[rank] = tok
        self.numbers = {tok: rank.to_bytes(4, "little") for tok, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        ranks, numbers = self.ranks, self.numbers
        whole = numbers.get(piece)
        if whole is not None:
            return whole
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        filed = [-1] * n  # the rank under which the pair that starts here is filed now
        queue, get = self.queue, ranks.get
        buckets, level0, level1 = queue.buckets, queue.level0, queue.level1
        push = queue.push
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                filed[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # positions come in order here, so the list stays a heap
                else:
                    buckets[rank] = [i]
                    word = rank >> 6
                    if not level0[word]:
                        level1[word >> 6] |= 1 << (word & 63)
                        queue.level2 |= 1 << (word >> 6)
                    level0[word] |= 1 << (rank & 63)
        while queue.level2:
            rank, i = queue.pop()
            if filed[i] != rank:
                continue  # stale
            j = after[i]
            merged = parts[i] = parts[i] + parts[j]
            parts[j] = None
            filed[j] = -1
            k = after[i] = after[j]
            filed[i] = -1
            if k < n:
                before[k] = i
                rank = get(merged + parts[k])
                if rank is not None:
                    filed[i] = rank
                    push(rank, i)
            h = before[i]
            if h >= 0:
                rank = get(parts[h] + merged)
                if rank is None:
                    filed[h] = -1
                elif rank != filed[h]:
                    filed[h] = rank
                    push(rank, h)
        return b"".join([numbers[p] for p in parts if p is not None])

    def packed(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        raw = piece.encode("utf-8")
        ids = self.merge(raw)
        if len(raw) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode_packed(self, text: str) -> bytes:
        get, packed = self.cache.get, self.packed
        return b"".join([get(p) or packed(p) for p in self.find(text)])

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process and rank file."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = ByteBPE(read_ranks(path), pattern)
    return _CODECS[key]


def digest_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path, pattern)
    for batch in batches:
        n_tokens, ids_hash, text_hash = [], [], []
        for text in batch.column(1):
            ids = bpe.encode_packed(text.as_py() or "")
            n_tokens.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(bpe.decode(memoryview(ids).cast("I").tolist())).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) for each row: the encoding itself."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``data`` (binary) from the rows of :func:`encode`."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            data = [bpe.decode(i.as_py() or ()) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digest columns of each whole text's ids and of the bytes decoded from them, in one pass without a shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lambda b: digest_batches(b, path, pattern), SCHEMA)
