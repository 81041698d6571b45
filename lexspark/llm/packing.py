"""Harmonic packing of token sequences.

A bin holds ``capacity`` tokens.  Class k takes the lengths in (capacity/(k+1), capacity/k], and a bin of
class k takes exactly k pieces, whatever their lengths, so every worker fills its own bins with one counter
per class and never looks at another's.  Documents may be cut, so each is cut into full bins and then,
greedily, into pieces of the largest length of some class k <= 16, which fill their bins to within k-1
tokens; the tail that is left (under capacity/16 tokens) goes to its class k >= 16, whose bins waste at most
one part in 17.

A worker ends with under k pieces in the open bin of class k.  These remainders are bounded by the number of
classes whatever the input; they are packed again, those of ``GROUP`` workers together: by class first, and
what then remains (again under k pieces of a class) first-fit by falling length.

Cases: the text of an added token (``<|endoftext|>``) is that token; null text counts as empty, and an empty text is the end id alone; repeated rows are separate
documents; a null doc_id is kept; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE
from .work import written

CAPACITY = 1024
#: Pieces of class k up to this are cut to the class's largest length.
CUT_CLASSES = 16
#: Workers whose remainders are packed together.
GROUP = 64
#: Texts beyond this many characters go to our own encoder, which gives the same ids in time that doesn't grow
#: with the square of a long pre-token, and needs no backtracking.
LONG_TEXT = 1_000_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = -(-capacity // rest)  # the smallest k whose largest length is at most rest
        k += capacity // k > rest
        piece = capacity // k if k <= CUT_CLASSES else rest
        out.append(piece)
        rest -= piece
    return out


def read_tokenizer(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks of a byte-level BPE ``tokenizer.json``, whose characters stand for bytes, and its added tokens.

    The text of an added token is that token wherever it stands in a text, and never a rank.
    """
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    vocab, added = read["model"]["vocab"], {t["content"]: t["id"] for t in read["added_tokens"]}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {bytes(map(char.__getitem__, tok)): i for tok, i in vocab.items() if tok not in added and all(c in char for c in tok)}, added


_ENCODERS: dict[tuple[str, str], tuple[tiktoken.Encoding, ByteBPE, dict[str, int]]] = {}


def encoder(path: str, pattern: str):
    """text -> ids as little-endian unsigned 32-bit integers, as the tokenizers library gives them without special tokens around."""
    if (path, pattern) not in _ENCODERS:
        ranks, added = read_tokenizer(path)
        _ENCODERS[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added), ByteBPE(ranks, pattern), added
    quick, long, added = _ENCODERS[path, pattern]
    parted = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")" if added else "(?!)")

    def encode(text: str) -> bytes:
        if len(text) > LONG_TEXT:
            return b"".join(added[part].to_bytes(4, "little") if part in added else long.encode_packed(part) for part in parted.split(text) if part)
        return quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    return encode


class Harmonic:
    """Open bins of one worker, at most one for each class."""

    def __init__(self, base: int, capacity: int = CAPACITY):
        self.base, self.capacity, self.made = base, capacity, 0
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def close(self, pieces: list[tuple]) -> list[tuple]:
        sequence, at, out = self.base + self.made, 0, []
        self.made += 1
        for p in pieces:
            out.append((*p[:5], sequence, at))
            at += p[2]
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """The pieces of the bin that this one completes, else none."""
        k = self.capacity // piece[2]
        held = self.open[k]
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self.close(held)

    def remainders(self) -> list[tuple]:
        return [p for k in sorted(self.open) for p in self.open[k]]

    def first_fit(self) -> list[tuple]:
        """Closes what is open: under k pieces of each class k, laid first-fit by falling length."""
        bins: list[list] = []
        for p in sorted(self.remainders(), key=lambda p: (-p[2], p[0] is not None, p[0] or 0, p[1])):
            for b in bins:
                if b[0] + p[2] <= self.capacity:
                    b[0] += p[2]
                    b[1].append(p)
                    break
            else:
                bins.append([p[2], [p]])
        self.open.clear()
        return [x for _, held in bins for x in self.close(held)]


def _batch(rows: list[tuple], more: list | None = None) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    arrays = [pa.array(c, pa.int64()) for c in columns]
    if more is not None:
        arrays.append(pa.array(more, pa.int32()))
        names.append("worker")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def pack_worker(batches, path: str, pattern: str, end_id: int, capacity: int):
    worker = TaskContext.get().partitionId()
    bins, encode, end = Harmonic(worker << 36, capacity), encoder(path, pattern), end_id.to_bytes(4, "little")
    for batch in batches:
        done: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "") + end
            total, start = len(ids) // 4, 0
            for n in cuts(total, capacity):
                done += bins.add((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total))
                start += n
        yield _batch(done, [worker] * len(done))
    left = [(*p, None, None) for p in bins.remainders()]
    yield _batch(left, [worker] * len(left))


def pack_rest(batches, capacity: int):
    held: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            held[row[5]].append(row[:5])
    for group in sorted(held):
        bins, done = Harmonic(1 << 62 | group << 36, capacity), []
        for p in sorted(held[group], key=lambda p: (p[0] is not None, p[0] or 0, p[1], p[2], p[3])):
            done += bins.add(p)
        yield _batch(done + bins.first_fit())


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: document, place in it, sequence and place there.

    Texts are encoded once; the written pieces hold no ids.  Only the workers' remainders are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    pieces = written(rows.mapInArrow(lambda b: pack_worker(b, path, pattern, end_id, capacity), f"{PIECE}, worker int"), "pieces")
    packed = pieces.where(F.col("sequence_id").isNotNull()).drop("worker")
    left = pieces.where(F.col("sequence_id").isNull()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.floor(F.col("worker") / GROUP).alias("group"))
    rest = left.repartition("group").mapInArrow(lambda b: pack_rest(b, capacity), PIECE)
    return packed.unionByName(rest)
