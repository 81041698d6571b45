"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, partitioned tables.

P(w | h) is d(c) c / c(h) where the n-gram was seen c times after h, else alpha(h) P(w | shorter h).  d is the
Good-Turing discount for counts up to ``TOP``, from the counts of counts of the order; alpha(h) is the mass that
discounting frees, divided by the shorter model's mass of the words never seen after h, so that every
distribution adds up to 1 over the known words and one unknown word.

**The tables.**  ``words`` (bucket, data) holds word hashes and counts; a word's number is its rank by count in its
bucket.  ``grams`` (order, bucket, data) is a trie dealt over buckets: contexts by number, the words seen after
each, their counts, and each context's backoff weight.  An n-gram's number is its bucket and its rank there, and
it names the context of the n-grams that go on from it, so longer n-grams lie in the same bucket as the
shorter one they go on from.  ``shared`` holds the sums of contexts that alone would fill a bucket: those are dealt over
several buckets by their next word.  ``meta`` is one row: discounts and sizes.

**How they are made.**  Texts become *blocks*: token numbers with the block's own word list, in a table that is
bucketed by block.  For each order a block tells its distinct n-grams to the buckets, already counted, as packed arrays
of differences; a bucket adds up, writes its part of the table and answers each block.  Answers come back to
the block by its number, against the bucketed table, so texts are never shuffled.  Each token's probability is
evaluated recursively from the answers of all orders.  :func:`apply` scores other texts against the stored tables.

Words are told apart by 64-bit hashes; contexts are exact.  A message holds about BLOCK_TOKENS / buckets n-grams, so
on a far larger corpus both sizes should rise with executor memory.  The training rows are those whose crc32(doc_id
as text) mod 7 isn't 2; all rows are scored.

Cases: null text is empty and scores its end token; a null doc_id counts as the empty text and is kept; repeated
rows are repeated in training as in the result; texts of any length stay whole (a block has at least one); other
columns are ignored; an empty table gives no rows; without training rows every token is the unknown word and
all scores are 0; words of one count are ranked by hash, which moves numbers but no score.
"""

from __future__ import annotations

import atexit
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import drop_dir, dropped, memory_returned, remainder, shuffles_freed, work_path, written

#: Counts up to this are discounted; tokens of a block and of a bucket, about.
TOP = 5
BLOCK_TOKENS = 700_000
BUCKET_TOKENS = 1_000_000
#: Bits of a number that tell its rank in a bucket.
RANK = 40

END = xxhash.xxh64_intdigest(b"\n end")  # no word holds a line break
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# -- packed arrays -----------------------------------------------------------------------------------------

CODEC = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers (or doubles, by their bits) as planes of bytes, each deflated alone where that helps."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        a = a.view(np.uint64) if a.dtype == np.float64 else a.astype(np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        out.append(struct.pack("<IB", len(a), width))
        for plane in np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T):
            if plane.min() == plane.max():
                out.append(struct.pack("<I", 1) + plane[:1].tobytes())
                continue
            raw = plane.tobytes()
            small = CODEC.compress(raw, asbytes=True) if len(raw) > 64 else raw
            body = small if len(small) < len(raw) else raw
            out.append(struct.pack("<I", len(body)) + body)
    return b"".join(out)


def unpack(b: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(b):
        n, width = struct.unpack_from("<IB", b, at)
        at += 5
        planes = np.zeros((n, 8), np.uint8)
        for i in range(width):
            (size,) = struct.unpack_from("<I", b, at)
            body = b[at + 4 : at + 4 + size]
            at += 4 + size
            if size == 1:
                planes[:, i] = body[0]
            else:
                planes[:, i] = np.frombuffer(body if size == n else CODEC.decompress(body, n, asbytes=True), np.uint8)
        out.append(planes.reshape(-1).view(np.uint64))
    return out


def differences(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers.astype(np.uint64), prepend=np.uint64(0))


def doubles(a: np.ndarray) -> np.ndarray:
    return a.view(np.float64)


def hashed(a: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# -- blocks ------------------------------------------------------------------------------------------------

BLOCK = "block long, starts long, size long, n_words long, doc_ids array<long>, train binary, data binary"


def make_blocks(batches):
    part, made = TaskContext.get().partitionId(), 0
    ids, train, lengths, tokens, vocabulary = [], [], [], [], {}

    def block():
        words = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
        numbers = np.array(tokens)
        common = np.argsort(-np.bincount(numbers), kind="stable")  # small numbers for common words pack well
        rank = np.empty(len(words), np.int64)
        rank[common] = np.arange(len(words))
        row = [[part << 24 | made], [sum(train)], [len(tokens)], [len(words)], [ids], [np.array(train, bool).tobytes()], [pack(np.array(lengths), rank[numbers], words[common])]]
        kinds = [*[pa.int64()] * 4, pa.list_(pa.int64()), *[pa.binary()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCK.split(", ")])

    for batch in batches:
        for doc_id, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = (text.as_py() or "").encode().lower().split()
            number = vocabulary.setdefault
            tokens += [number(w, len(vocabulary)) for w in words]
            tokens.append(number(None, len(vocabulary)))
            ids.append(doc_id), train.append(learn), lengths.append(len(words) + 1)
            if len(tokens) >= BLOCK_TOKENS:
                yield block()
                made += 1
                ids, train, lengths, tokens, vocabulary = [], [], [], [], {}
    if ids:
        yield block()


class Block:
    """One row of the table of blocks."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["block"], row["doc_ids"]
        self.train = np.frombuffer(row["train"], bool)
        lengths, tokens, self.words = unpack(row["data"])
        self.lengths, self.tokens = lengths.astype(np.int64), tokens.astype(np.int32)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.learn = self.train[self.doc]
        self.first = np.r_[0, np.cumsum(self.lengths)[:-1]]

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in the order they are asked, and where each bucket's begin."""
        place = (self.words % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.words, place))
        return order, np.searchsorted(place[order], np.arange(buckets + 1))

    def before(self, a: np.ndarray, start: int) -> np.ndarray:
        """Of each token: what ``a`` has for the token before it, ``start`` where there is none."""
        out = np.roll(a, 1)
        out[self.first] = start
        return out


# -- words -------------------------------------------------------------------------------------------------

OUT = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("stats", pa.list_(pa.float64())), ("contexts", pa.list_(pa.int64()))])
OUT_SQL = "kind string, block long, bucket int, data binary, stats array<double>, contexts array<long>"
ASK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("contexts", pa.list_(pa.int64())), ("data", pa.binary())])
ASK_SQL = "block long, bucket int, contexts array<long>, data binary"


def ask_words(batches, buckets: int):
    for batch in batches:
        for row in batch.to_pylist():
            b = Block(row)
            counts = np.bincount(b.tokens[b.learn], minlength=len(b.words))
            order, cut = b.by_bucket(buckets)
            for k in np.flatnonzero(np.diff(cut)):
                at = order[cut[k] : cut[k + 1]]
                yield pa.RecordBatch.from_pylist([{"block": b.number, "bucket": int(k), "data": pack(differences(b.words[at]), counts[at])}], schema=ASK)


def counts_of_counts(c: np.ndarray) -> list[float]:
    return [float((c == r).sum()) for r in range(1, TOP + 2)]


def count_words(table: pa.Table) -> pa.Table:
    """Adds up a bucket, ranks its words by count and answers with counts and ranks."""
    rows = table.to_pylist()
    asked = [unpack(r.pop("data")) for r in rows]
    words = [np.cumsum(w, dtype=np.uint64) for w, _ in asked]
    unique, inverse = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([c for _, c in asked]), minlength=len(unique)).astype(np.int64)
    order = np.lexsort((unique, -total))
    rank = np.empty(len(unique), np.int64)
    rank[order] = np.arange(len(unique))
    known, bucket = order[total[order] > 0], rows[0]["bucket"]
    out = [{"kind": "table", "bucket": bucket, "data": pack(unique[known], total[known])}]
    out.append({"kind": "stats", "bucket": bucket, "stats": [float(total.sum()), float(len(known)), *counts_of_counts(total)]})
    at = 0
    for r, w in zip(rows, words):
        mine = inverse[at : at + len(w)]
        out.append({"kind": "answer", "block": r["block"], "bucket": bucket, "data": pack(total[mine], rank[mine])})
        at += len(w)
    return pa.Table.from_pylist(out, schema=OUT)


def look_up_words(asked: pa.Table, table: pa.Table) -> pa.Table:
    """Answers from a bucket's stored words: an unknown one has no count."""
    words, counts = unpack(table["data"][0].as_py()) if len(table) else [np.zeros(0, np.uint64)] * 2
    order = np.argsort(words)
    out = []
    for r in asked.to_pylist():
        w = np.cumsum(unpack(r["data"])[0], dtype=np.uint64)
        at = found(words[order], w)
        rank = np.where(at >= 0, order[at] if len(order) else 0, len(order))  # no stored n-gram has a word of that rank
        out.append({"kind": "answer", "block": r["block"], "bucket": r["bucket"], "data": pack(np.r_[counts, np.uint64(0)][rank], rank)})
    return pa.Table.from_pylist(out, schema=OUT)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place where each is, and which of them each key is."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    which = np.empty(len(k), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return k[new], order[new], which


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is, -1 where it isn't."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


# -- discounts and probabilities ---------------------------------------------------------------------------

def discounts(n: list[float]) -> np.ndarray:
    """d[1..TOP] from the counts of counts n[0..TOP] (of 1 .. TOP+1).

    Katz's Good-Turing discounts where all lie between 0 and 1; else, as copies in a corpus upset single counts
    of counts, those of a line through their logarithms; else r-1/2 of r.
    """
    r = np.arange(1, TOP + 2)

    def katz(n: np.ndarray) -> np.ndarray | None:
        a = (TOP + 1) * n[TOP] / n[0]
        if a >= 1:
            return None
        d = (r[1:] * n[1:] / (r[:-1] * n[:-1]) - a) / (1 - a)
        return np.r_[1.0, d] if ((d > 0) & (d < 1)).all() else None

    counts = np.array(n, float)
    made = None
    if (counts > 0).all():
        made = katz(counts)
        if made is None:
            slope, height = np.polyfit(np.log(r), np.log(counts), 1)
            made = katz(np.exp(height + slope * np.log(r)))
    return np.r_[1.0, (r[:-1] - 0.5) / r[:-1]] if made is None else made


class Unigrams:
    """P(w): discounted counts, and one unknown word with what is left."""

    def __init__(self, stats: list[float]):
        self.tokens, self.types, n = stats[0], stats[1], stats[2:]
        self.d = discounts(n)
        freed = sum((1 - self.d[r]) * r * n[r - 1] for r in range(1, TOP + 1))
        self.scale = 1.0
        if self.tokens and freed <= 0:
            self.scale, freed = self.tokens / (self.tokens + 1), self.tokens / (self.tokens + 1)
        self.unknown = freed / self.tokens if self.tokens else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        d = self.d[np.where(c <= TOP, c, 0).astype(np.int64)]
        return np.where(c > 0, self.scale * d * c / max(self.tokens, 1), self.unknown)


#: Of a context: some count of it is discounted; some word was never seen after it.
LOW, REST = 1, 2
#: Sums of a context: n-grams of each count to TOP, and the shorter model's mass of what was seen.
SUMS = TOP + 1


def seen(c: np.ndarray, total: np.ndarray, flags: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P of words seen ``c`` times after contexts of ``total`` tokens.

    Where no count is low enough to be discounted one more token is set aside for the unseen; where nothing is unseen, none.
    """
    total = np.maximum(total, 1).astype(float)
    scale = np.where(flags & LOW, 1.0, total / (total + 1))
    plain = c / total
    return np.where(flags & REST, scale * d[np.where(c <= TOP, c, 0).astype(np.int64)] * plain, plain)


def context_flags(sums: np.ndarray) -> np.ndarray:
    return np.where(sums[:, :TOP].sum(axis=1) > 0, LOW, 0) | np.where(1 - sums[:, TOP] > 1e-12, REST, 0)


def backoff_weights(sums: np.ndarray, total: np.ndarray, d: np.ndarray) -> np.ndarray:
    flags, total = context_flags(sums), np.maximum(total, 1).astype(float)
    mass = sum((1 - d[r]) * r * sums[:, r - 1] for r in range(1, TOP + 1)) / total
    mass = np.where(flags & LOW, mass, 1 / (total + 1))
    return np.divide(mass, 1 - sums[:, TOP], out=np.zeros(len(sums)), where=(flags & REST) > 0)


# -- longer n-grams ----------------------------------------------------------------------------------------

#: A context that is dealt over several buckets, beside LOW and REST of the shorter context in what a block tells.
SPREAD = 4


class Grams:
    """The distinct n-grams of a block whose context was trained, in the order it asks: by bucket, context, word.

    ``local`` tells which of ``names``, the sorted numbers of contexts, each token has; 0 is the start.
    """

    def __init__(self, b: Block, local: np.ndarray, names: np.ndarray, common: np.ndarray, levels: Levels):
        self.at = np.flatnonzero(common > 0)
        key, first, inverse = distinct(local[self.at] << 32 | b.rank[b.tokens[self.at]])
        first = self.at[first]
        c, w = np.r_[np.uint64(0), names][key >> 32], b.names[b.by_name[key & 0xFFFFFFFF]]
        spread = np.maximum(1, np.ceil(common[first] / levels.heavy)).astype(np.uint64)
        place = (((c >> np.uint64(RANK)) + hashed(w) % spread) % np.uint64(levels.buckets)).astype(np.int64)
        by = np.argsort(place, kind="stable")
        del key
        self.first, self.contexts, self.words, self.place, self.shared = first[by], c[by], w[by], place[by], spread[by] > 1
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        self.inverse = rank[inverse]  # token asked about -> n-gram
        self.counts = np.bincount(self.inverse[b.learn[self.at]], minlength=len(by))
        new = np.r_[True, (self.contexts[1:] != self.contexts[:-1]) | (self.place[1:] != self.place[:-1])] if len(by) else np.zeros(0, bool)
        self.run_starts = np.flatnonzero(new)
        self.run = np.cumsum(new, dtype=np.int32) - 1  # n-gram -> run of one context in one bucket
        self.run_total = common[self.first[self.run_starts]]
        self.run_shared = self.shared[self.run_starts]

    def asked(self, block: int, count: np.ndarray, total: np.ndarray, flags: np.ndarray, of: tuple[int, int]):
        """Messages: contexts, words, counts, and what the shorter model's P is worked out from (whole numbers)."""
        bounds, buckets = np.r_[self.run_starts, len(self.contexts)], self.place[self.run_starts]
        cut = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True]) if len(buckets) else np.zeros(1, int)
        lower = np.where(self.counts > 0, count[self.first], 0)
        for i, j in zip(cut[:-1], cut[1:]):
            s, e, at = bounds[i], bounds[j], self.run_starts[i:j]
            if buckets[i] % of[1] != of[0]:
                continue
            marks = flags[self.first[at]] | np.where(self.run_shared[i:j], SPREAD, 0)
            data = pack(differences(self.contexts[at]), np.diff(bounds[i : j + 1]), self.words[s:e], self.counts[s:e], lower[s:e], total[self.first[at]], marks, self.run_total[i:j])
            yield {"block": block, "bucket": int(buckets[i]), "contexts": self.contexts[at][self.run_shared[i:j]].view(np.int64).tolist(), "data": data}


def merged(keys: np.ndarray, counts: np.ndarray, lower: np.ndarray):
    """Distinct sorted keys, their counts added up and the largest of ``lower``, and where each key went."""
    by = np.argsort(keys)
    k = keys[by]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    where = np.empty(len(keys), np.int32)
    where[by] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(k)]))
    return k[starts], np.add.reduceat(counts[by], starts), np.maximum.reduceat(lower[by], starts), where


def count_grams(table: pa.Table, levels: Levels, last: bool) -> pa.Table:
    """Adds up a bucket, gives its part of the table and answers: counts, numbers, and sums of the contexts that someone backs off from."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    asked = [unpack(r.pop("data")) for r in rows]
    join = lambda i: np.concatenate([a[i] for a in asked])
    runs = [a[1].astype(np.int64) for a in asked]
    names, dense = np.unique(np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked]), return_inverse=True)
    of_run = np.zeros((3, len(names)), np.int64)  # the shorter context's tokens and marks, and the context's own tokens
    for i, column in enumerate((5, 6, 7)):
        of_run[i, dense] = join(column).astype(np.int64)
    keys = np.repeat(dense.astype(np.uint64), np.concatenate(runs)) << np.uint64(RANK)
    keys |= join(2)
    counts, lower = join(3).astype(np.int64), join(4).astype(np.int64)
    del asked, join
    keys, total, low, where = merged(keys, counts, lower)
    del counts, lower
    of = (keys >> np.uint64(RANK)).astype(np.int64)
    trained = total > 0
    p = levels.unigrams.p(low) if not levels.orders else seen(low, of_run[0, of], of_run[1, of], levels.orders[-1])
    sums = np.zeros((len(names), SUMS))
    for r in range(1, TOP + 1):
        sums[:, r - 1] = np.bincount(of, weights=total == r, minlength=len(names))
    sums[:, TOP] = np.bincount(of, weights=np.where(trained, p, 0.0), minlength=len(names))
    number, flags, shared, bucket = np.cumsum(trained), context_flags(sums), (of_run[1] & SPREAD) > 0, rows[0]["bucket"]
    out = [{"kind": "shared", "contexts": [int(c)], "stats": s.tolist()} for c, s in zip(names[shared].view(np.int64), sums[shared])]
    out.append({"kind": "stats", "bucket": bucket, "stats": counts_of_counts(total)})
    lengths = np.bincount(of[trained], minlength=len(names))
    kept = np.flatnonzero(lengths)  # contexts of some trained n-gram here
    data = pack(differences(names[kept]), lengths[kept], (keys & np.uint64((1 << RANK) - 1))[trained], total[trained], of_run[2][kept], *sums[kept, :TOP].T.astype(np.int64), sums[kept, TOP])
    out.append({"kind": "table", "bucket": bucket, "data": data, "contexts": names[kept][shared[kept]].view(np.int64).tolist()})
    gram = run = 0
    for r, n in zip(rows, runs):
        g, d = where[gram : gram + n.sum()], dense[run : run + len(n)]
        gram, run = gram + n.sum(), run + len(n)
        c = total[g]
        wanted = d[np.minimum.reduceat(c, np.r_[0, np.cumsum(n)[:-1]]) == 0]
        wanted = wanted[~shared[wanted]]
        data = pack(c, np.zeros(0) if last else differences(number[g][c > 0]), flags[d], *sums[wanted, :TOP].T.astype(np.int64), sums[wanted, TOP])
        out.append({"kind": "answer", "block": r["block"], "bucket": bucket, "data": data, "contexts": r["contexts"]})
    return pa.Table.from_pylist(out, schema=OUT)


class Part:
    """A bucket's part of the table of one order."""

    def __init__(self, data: bytes | None):
        if data is None:
            self.contexts = self.words = self.counts = self.run = self.flags = self.weights = np.zeros(0, np.uint64)
            return
        contexts, runs, self.words, self.counts, self.total, flags, weights = unpack(data)
        self.contexts, self.flags, self.weights = np.cumsum(contexts, dtype=np.uint64), flags.astype(np.int64), doubles(weights)
        self.run = np.repeat(np.arange(len(runs)), runs.astype(np.int64))


def look_up_grams(asked: pa.Table, table: pa.Table) -> pa.Table:
    """Answers from a bucket's stored part: counts, numbers, and the weight of each context that someone backs off from."""
    part, out = Part(table["data"][0].as_py() if len(table) else None), []
    keys = part.run.astype(np.uint64) << np.uint64(RANK) | part.words
    for r in asked.to_pylist():
        contexts, runs, words, *_, marks, _ = unpack(r["data"])
        runs = runs.astype(np.int64)
        of = found(part.contexts, np.cumsum(contexts, dtype=np.uint64))
        g_of = np.repeat(of, runs)
        at = np.where(g_of >= 0, found(keys, np.maximum(g_of, 0).astype(np.uint64) << np.uint64(RANK) | words), -1)
        c = np.where(at >= 0, part.counts[at] if len(keys) else 0, 0).astype(np.int64)
        wanted = (np.minimum.reduceat(c, np.r_[0, np.cumsum(runs)[:-1]]) == 0) & ((marks.astype(np.int64) & SPREAD) == 0)
        flags = np.where(of >= 0, part.flags[of] if len(part.flags) else 0, 0)
        data = pack(c, differences((at + 1)[c > 0]), flags, part.weights[of[wanted]])
        out.append({"kind": "answer", "block": r["block"], "bucket": r["bucket"], "data": data, "contexts": r["contexts"]})
    return pa.Table.from_pylist(out, schema=OUT)


def weigh(batches, d: np.ndarray):
    """Parts with sums made parts with flags and backoff weights; ``shared`` has the whole sums of contexts dealt over several buckets."""
    for batch in batches:
        for row in batch.to_pylist():
            contexts, runs, words, counts, total, *sums = unpack(row["data"])
            sums = np.vstack([*(x.astype(float) for x in sums[:TOP]), doubles(sums[TOP])]).T
            names = np.cumsum(contexts, dtype=np.uint64)
            for s in row["shared"] or []:
                sums[np.searchsorted(names, np.uint64(s["context"] % (1 << 64)))] = s["stats"]
            data = pack(contexts, runs, words, counts, total, context_flags(sums), backoff_weights(sums, total.astype(np.int64), d))
            yield pa.RecordBatch.from_pylist([{"bucket": row["bucket"], "data": data}], schema=pa.schema([("bucket", pa.int32()), ("data", pa.binary())]))


class Levels:
    """What is known of the whole model: discounts of each order and sizes.  None of it grows with the corpus."""

    def __init__(self, stats: list[float], starts: int, buckets: int, word_buckets: int):
        self.stats, self.starts, self.buckets, self.word_buckets = stats, starts, buckets, word_buckets
        self.unigrams, self.orders = Unigrams(stats), []
        self.heavy = max(1.0, stats[0] / buckets)

    def saved(self) -> str:
        return json.dumps([self.stats, self.starts, self.buckets, self.word_buckets, [d.tolist() for d in self.orders]])

    @classmethod
    def loaded(cls, text: str) -> Levels:
        *known, orders = json.loads(text)
        out = cls(*known)
        out.orders = [np.array(d) for d in orders]
        return out

    def upto(self, n: int) -> Levels:
        """The model of the orders to ``n``."""
        out = Levels(self.stats, self.starts, self.buckets, self.word_buckets)
        out.orders = self.orders[: n - 1]
        return out

    def evaluate(self, row: dict):
        """The block with counts of its words, P of each token by all orders that are answered, and what the next order is asked from."""
        b = Block(row)
        order, _ = b.by_bucket(self.word_buckets)
        answers = [sorted(row[f"answers{n}"] or [], key=lambda a: a["bucket"]) for n in range(1, 2 + len(self.orders))]
        words, names = np.empty(len(b.words), np.int64), np.empty(len(b.words), np.uint64)
        of_bucket = [unpack(a["data"]) for a in answers[0]]
        words[order] = np.concatenate([c for c, _ in of_bucket])
        names[order] = np.concatenate([rank * np.uint64(self.word_buckets) + np.uint64(a["bucket"] + 1) for a, (_, rank) in zip(answers[0], of_bucket)])
        b.names, b.by_name = names, np.argsort(names, kind="stable")
        b.rank = np.empty(len(names), np.int64)
        b.rank[b.by_name] = np.arange(len(names))
        p, count = self.unigrams.p(words)[b.tokens], words[b.tokens]
        number = (hashed(names) % np.uint64(self.buckets)) << np.uint64(RANK) | names
        by_number = np.argsort(number)
        local, number = np.empty(len(names), np.int64), number[by_number]
        local[by_number] = np.arange(len(names))
        local = local[b.tokens]
        total, flags = np.zeros(len(p), np.int64), np.zeros(len(p), np.int8)
        for n, d in enumerate(self.orders, 2):
            common = b.before(count, self.starts)
            g = Grams(b, b.before(local + 1, 0), number, common, self)
            got = [unpack(a["data"]) for a in answers[n - 1]]
            c = np.concatenate([x[0] for x in got]).astype(np.int64) if got else np.zeros(0, np.int64)
            run_flags, weights = np.zeros(len(g.run_starts), np.int64), np.zeros(len(g.run_starts))
            if got:
                run_flags[:] = np.concatenate([x[2] for x in got])
                backed_off = np.minimum.reduceat(c, g.run_starts) == 0
                mine = np.flatnonzero(backed_off & ~g.run_shared)
                if len(got[0]) == 4:  # weights
                    weights[mine] = np.concatenate([doubles(x[3]) for x in got])
                else:
                    sums = np.vstack([*(np.concatenate([x[3 + i] for x in got]).astype(float) for i in range(TOP)), np.concatenate([doubles(x[3 + TOP]) for x in got])]).T
                    weights[mine] = backoff_weights(sums, g.run_total[mine], d)
                whole = {s["context"] % (1 << 64): s["stats"] for s in row[f"shared{n}"] or []}
                for i in np.flatnonzero(g.run_shared):
                    sums = np.array([whole[int(g.contexts[g.run_starts[i]])]])
                    run_flags[i], weights[i] = context_flags(sums)[0], backoff_weights(sums, g.run_total[i : i + 1], d)[0]
            count, total, flags = np.zeros(len(p), np.int64), common, np.zeros(len(p), np.int8)
            local, number = np.zeros(len(p), np.int64), np.zeros(len(c), np.uint64)
            count[g.at] = c[g.inverse]
            flags[g.at] = run_flags[g.run][g.inverse]
            higher = seen(count[g.at], common[g.at], flags[g.at], d)
            p[g.at] = np.maximum(np.where(count[g.at] > 0, higher, weights[g.run][g.inverse] * p[g.at]), 1e-300)
            local[g.at] = g.inverse
            if got and sum(len(x[1]) for x in got):  # in the order of the n-grams, as buckets rank by context and word
                number[c > 0] = np.concatenate([np.cumsum(x[1], dtype=np.uint64) | np.uint64(a["bucket"]) << np.uint64(RANK) for a, x in zip(answers[n - 1], got)])
            del g, got, c, common  # before the next order's are made
        return b, words, p, (count, total, flags, local, number)

    def ask(self, row: dict, of: tuple[int, int] = (0, 1)):
        """Messages to the buckets of one pass ``of`` (number, passes)."""
        b, _, _, (count, total, flags, local, number) = self.evaluate(row)
        yield from Grams(b, b.before(local + 1, 0), number, b.before(count, self.starts), self).asked(b.number, count, total, flags, of)

    def scores(self, row: dict):
        b, words, p, _ = self.evaluate(row)
        n, v = self.unigrams.tokens, self.unigrams.types
        base = np.log10((words + 1) / (n + v + 1))[b.tokens]
        docs = len(b.doc_ids)
        add = lambda x: np.bincount(b.doc, weights=x, minlength=docs)
        columns = [b.doc_ids, ~b.train, b.lengths, add(words[b.tokens] > 0).astype(np.int64), np.full(docs, int(n)), add(base), add(np.log10(p))]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in RESULT.split(", ")])


# -- jobs --------------------------------------------------------------------------------------------------

def bucketed(df: DataFrame, by: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed so that later joins on ``by`` leave it where it is."""
    spark = df.sparkSession
    name, path = f"lexspark_{uuid.uuid4().hex}", work_path(spark, "bucketed")
    with shuffles_freed(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.drop_table = lambda: _drop_table(spark, name, path)
    atexit.register(out.drop_table)
    return out


def _drop_table(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_dir(spark, path)
    except Exception:  # the session has ended
        return


def blocks_of(docs: DataFrame, held_out_modulus: int, held_out_remainder: int) -> DataFrame:
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), held_out_modulus) != held_out_remainder).alias("train"), F.col("text").cast("string").alias("text")
    )
    return bucketed(rows.mapInArrow(make_blocks, BLOCK), "block")


def whole_sums(rows: DataFrame, by: str, totals: DataFrame) -> DataFrame:
    """For each ``by``: the whole sums of the contexts its rows name, which are dealt over several buckets."""
    named = rows.select(by, F.explode("contexts").alias("context")).distinct().join(totals, "context")
    return named.groupBy(by).agg(F.collect_list(F.struct("context", "stats")).alias("shared"))


def shared_totals(out: DataFrame) -> DataFrame:
    parts = out.where("kind = 'shared'").select(F.col("contexts")[0].alias("context"), "stats")
    return parts.groupBy("context").agg(F.array(*[F.sum(F.get("stats", F.lit(i))) for i in range(SUMS)]).alias("stats"))


def answers_by_block(out: DataFrame) -> DataFrame:
    """Answers shuffled to their blocks once, in a table bucketed as that of the blocks."""
    n = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(out.where("kind = 'answer'").select("block", "bucket", "data", "contexts").repartition(n, "block"), "block")


def with_answers(blocks: DataFrame, answers: list[DataFrame], totals: list[DataFrame]) -> DataFrame:
    """Blocks with what each order answered; ``totals`` are of the orders from 2."""
    out = blocks
    for n, a in enumerate(answers, 1):
        out = out.join(a.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias(f"answers{n}")).hint("shuffle_merge"), "block", "left")
        if n > 1:
            out = out.join(whole_sums(a, "block", totals[n - 2]).withColumnRenamed("shared", f"shared{n}").hint("shuffle_merge"), "block", "left")
    return out


def asking(blocks: DataFrame, answers: list[DataFrame], totals: list[DataFrame], levels: Levels, of: tuple[int, int] = (0, 1)) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(levels.ask(row, of)), schema=ASK)
                memory_returned()

    return with_answers(blocks, answers, totals).mapInArrow(ask, ASK_SQL)


def counting(levels: Levels, last: bool):
    def count(table: pa.Table) -> pa.Table:
        try:
            return count_grams(table, levels, last)
        finally:
            memory_returned()

    return count


def weighing(d: np.ndarray):
    return lambda batches: weigh(batches, d)


def scoring(blocks: DataFrame, answers: list[DataFrame], totals: list[DataFrame], levels: Levels) -> DataFrame:
    """Scores as a written table, after which the blocks and answers are given back."""
    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield levels.scores(row)
                memory_returned()

    scored = with_answers(blocks, answers, totals).mapInArrow(score, RESULT)
    out = written(scored, "scores")
    for used in (*answers, blocks):
        used.drop_table()
    return out


class Model:
    """Stored tables of a model, under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.levels = Levels.loaded(spark.read.schema("meta string").parquet(f"{path}/meta").first().meta)

    @property
    def words(self) -> DataFrame:
        return self.spark.read.schema("bucket int, data binary").parquet(f"{self.path}/words")

    def grams(self, order: int) -> DataFrame:
        return self.spark.read.schema("bucket int, data binary").parquet(f"{self.path}/grams/order={order}")

    def shared(self, order: int) -> DataFrame:
        return self.spark.read.schema("context long, stats array<double>").parquet(f"{self.path}/shared/order={order}")


def fit(docs: DataFrame, order: int = 3, path: str | None = None, held_out_modulus: int = 7, held_out_remainder: int = 2) -> tuple[str, DataFrame]:
    """The folder of the model of the training documents, and every document scored by it.

    The buckets of order n are dealt in n - 1 passes: the shuffle of one is given back before the next, as the
    tables of the shorter orders lie beside it.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "katz")
    blocks = blocks_of(docs, held_out_modulus, held_out_remainder)
    size = blocks.agg(F.sum("size"), F.sum("n_words"), F.sum("starts")).first()
    tokens, words, starts = (x or 0 for x in size)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_buckets, buckets = (max(least, -(-n // BUCKET_TOKENS)) for n in (words, tokens))
    first = written(blocks.mapInArrow(lambda b: ask_words(b, word_buckets), ASK_SQL).groupBy("bucket").applyInArrow(count_words, OUT_SQL), "words", ["kind"])
    with shuffles_freed(spark):
        first.where("kind = 'table'").select("bucket", "data").write.parquet(f"{path}/words")
    stats = first.where("kind = 'stats'").select(*[F.sum(F.get("stats", F.lit(i))) for i in range(TOP + 3)]).first()
    levels = Levels([x or 0.0 for x in stats], starts, buckets, word_buckets)
    answers, totals, parts = [answers_by_block(first)], [], []
    dropped(first)
    for n in range(2, order + 1):
        counted = work_path(spark, "grams")
        for i in range(n - 1):
            asked = asking(blocks, answers, totals, levels.upto(n - 1), (i, n - 1))
            with shuffles_freed(spark):
                asked.groupBy("bucket").applyInArrow(counting(levels.upto(n - 1), n == order), OUT_SQL).write.mode("append").partitionBy("kind").parquet(counted)
        made = spark.read.schema(OUT_SQL).parquet(counted)
        stats = made.where("kind = 'stats'").select(*[F.sum(F.get("stats", F.lit(i))) for i in range(TOP + 1)]).first()
        levels.orders.append(discounts([x or 0.0 for x in stats]))
        with shuffles_freed(spark):
            shared_totals(made).write.parquet(f"{path}/shared/order={n}")
        totals.append(spark.read.schema("context long, stats array<double>").parquet(f"{path}/shared/order={n}"))
        answers.append(answers_by_block(made))
        drop_dir(spark, f"{counted}/kind=answer")
        parts.append(made.where("kind = 'table'"))
    scores = scoring(blocks, answers, totals, levels)
    for n, part in enumerate(parts, 2):  # now that discounts are known and the blocks are gone
        with shuffles_freed(spark):
            whole = part.join(whole_sums(part, "bucket", totals[n - 2]), "bucket", "left").select("bucket", "data", "shared")
            whole.mapInArrow(weighing(levels.orders[n - 2]), "bucket int, data binary").write.parquet(f"{path}/grams/order={n}")
        dropped(part)
    spark.createDataFrame([(levels.saved(),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")
    return path, scores


def apply(docs: DataFrame, path: str, held_out_modulus: int = 7, held_out_remainder: int = 2) -> DataFrame:
    """Documents scored by the stored model at ``path``; ``held_out`` is as they would have been in training."""
    model = Model(docs.sparkSession, path)
    levels = model.levels
    blocks = blocks_of(docs, held_out_modulus, held_out_remainder)
    asked = blocks.mapInArrow(lambda b: ask_words(b, levels.word_buckets), ASK_SQL)
    answers = [answers_by_block(asked.groupBy("bucket").cogroup(model.words.groupBy("bucket")).applyInArrow(look_up_words, OUT_SQL))]
    totals: list[DataFrame] = []
    for n in range(2, 2 + len(levels.orders)):
        asked = asking(blocks, answers, totals, levels.upto(n - 1))
        answers.append(answers_by_block(asked.groupBy("bucket").cogroup(model.grams(n).groupBy("bucket")).applyInArrow(look_up_grams, OUT_SQL)))
        totals.append(model.shared(n))
    return scoring(blocks, answers, totals, levels)


def score(docs: DataFrame, order: int = 3, held_out_modulus: int = 7, held_out_remainder: int = 2) -> DataFrame:
    """Every document scored by the model of the training documents."""
    return fit(docs, order, None, held_out_modulus, held_out_remainder)[1]
