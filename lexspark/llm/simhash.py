"""SimHash near-duplicates with pivot distance tables.

**Fingerprints.**  XXH64 (seed 42) of each run of words; a bit of the 64 is set if it is set in over half of
the hashes, repeats included.

**Links.**  Equal fingerprints are first brought together, so copies cost nothing further.  Fingerprints
within ``radius`` bits agree on all but ``radius`` of ``BLOCKS`` blocks of 8 bits, so every choice of the
BLOCKS - radius agreeing blocks is a bucket key and no link is lost.  The distinct fingerprints of one bucket
differ only in 8 * radius bits, which bounds a bucket (65,536 for 2) whatever the table.  In a bucket a table
holds the Hamming distances of every fingerprint to ``PIVOTS`` reference fingerprints; by the triangle
inequality a pair whose distances to some pivot differ by over ``radius`` is discarded, and the survivors are
verified by a full comparison.  A bucket gives one link for each fingerprint joined (to the least of its
class), never its pairs.

**Near copies by similarity** (:func:`near_copies`).  Runs of five words at a similarity of 0.8 lie 4 to 18 bits
apart on the test tables and further where a copy repeats a passage.  So the links of fingerprints come first, found as
above; each is verified by the exact similarity of the run sets.  For the classes they leave, buckets come from
least-hash samples of the same run hashes: two leaders of a bucket join most of it; then every pair of a bucket that
isn't joined is compared, in blocks.  The tables of
pivot distances are of the run sets here: a pivot is all hashes with a certain bit, and the size of a set's symmetric difference
to it follows from the sum that decides this bit of a fingerprint.  By the triangle inequality a pair whose distances to
some pivot differ by more than sets of that similarity can is discarded, which loses none; the exact similarity verifies
the rest.

Cases: null text is empty; without words the fingerprint is zero and links as any other; with fewer words than
a run the whole sequence is the one run; repeated rows share their class; a null doc_id has no class of its own
to offer and takes that of its fingerprint; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .work import dropped, free, written

BLOCKS, BLOCK_BITS = 8, 8
PIVOTS = 32
SEED = 42
#: Rows of a bucket compared at once: bounds memory.
STRIP = 512
#: Runs of a block of a bucket, about: bounds memory where texts are long.
STRIP_RUNS = 4_000_000

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_SPACE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def words_of(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered."""
    return [w for w in (text or "").translate(_LOWER).translate(_SPACE).split(" ") if w]


def run_hashes(words: list[str], size: int) -> np.ndarray:
    """Unsigned hashes of the runs of ``size`` words, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(" ".join(words), SEED)], np.uint64)
    raw = " ".join(words).encode()
    ends = np.cumsum([len(w) + 1 for w in map(str.encode, words)])
    starts = np.r_[0, ends[:-size]].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest first."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return set_bits


def fingerprint(hashes: np.ndarray) -> int:
    return int.from_bytes(np.packbits(2 * bit_sums(hashes) > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            fps = [signed(fingerprint(run_hashes(words_of(t.as_py()), size))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bucket_keys(fp: Column, radius: int) -> Column:
    """A key for each choice of agreeing blocks: the choice and the bits kept."""
    keys = []
    for number, kept in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        mask = sum(0xFF << (BLOCK_BITS * b) for b in kept)
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(signed(mask))).alias("bits")))
    return F.array(*keys)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: alternating stripes of every width, and hashes."""
    stripes = [sum(1 << i for i in range(64) if i // w % 2) for w in (1, 2, 4, 8, 16, 32)]
    return np.array([*stripes, *(xxhash.xxh64_intdigest(f"pivot {i}") for i in range(n))][:n], np.uint64)


def pivot_distances(fps: np.ndarray, reference: np.ndarray | None = None) -> np.ndarray:
    """The table of distances: a row for each fingerprint, a column for each pivot."""
    reference = pivots() if reference is None else reference
    return popcount(fps[:, None] ^ reference[None, :]).astype(np.int8)


def pivot_table(distinct: DataFrame) -> DataFrame:
    """``fp`` and its distances to all pivots (a byte each), worked out once and stored."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            rows = pivot_distances(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["fp", "distances"])

    stored = written(distinct.select("fp").mapInArrow(run, "fp long, distances binary"), "pivots")
    # a set number of parts: each row becomes 28 in the next step, and small files would be read by a few tasks
    return stored.repartition(n, "fp")


def linked(fps: np.ndarray, radius: int, table: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """For distinct fingerprints: the index of the least one of each's class, and how many pairs were verified.

    ``table`` has the distances to the pivots and is sorted by the first: only strips whose first distances come
    within ``radius`` meet, then all coordinates are compared, and what survives is verified.
    """
    table = pivot_distances(fps) if table is None else table
    if len(fps) == 2:  # most buckets: the same two steps for one pair
        near = int(np.abs(table[0] - table[1]).max()) <= radius
        return np.array([0, int(not (near and int(fps[0] ^ fps[1]).bit_count() <= radius))]), int(near)
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_fps = table[order], fps[order]
    parent = np.arange(len(fps))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    verified = 0
    for a in range(0, len(fps), STRIP):
        left = slice(a, min(a + STRIP, len(fps)))
        for b in range(a, len(fps), STRIP):
            right = slice(b, min(b + STRIP, len(fps)))
            if table[b, 0] > int(table[left.stop - 1, 0]) + radius:
                break
            near = np.ones((left.stop - left.start, right.stop - right.start), bool)
            for p in range(table.shape[1]):
                near &= np.abs(table[left, None, p] - table[None, right, p]) <= radius
            if a == b:
                near &= np.tri(*near.shape, -1, dtype=bool)
            i, j = np.nonzero(near)
            verified += len(i)
            real = popcount(sorted_fps[i + a] ^ sorted_fps[j + b]) <= radius
            for x, y in zip(order[i[real] + a].tolist(), order[j[real] + b].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(fps))], np.int64), verified


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b) for distinct fingerprints ``fp``: the classes of each bucket, one link for each member but the least."""
    # a group has distinct fingerprints that differ in 8 * radius bits only, so its size is bounded
    table = pivot_table(distinct)
    member = F.struct("fp", "distances").alias("member")
    groups = table.select(member, F.explode(bucket_keys(F.col("fp"), radius)).alias("key")).groupBy("key").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                fps, distances = members.values.flatten()
                fps = fps.to_numpy().view(np.uint64)
                distances = np.frombuffer(b"".join(distances.to_pylist()), np.int8).reshape(len(fps), -1)
                fps, at = np.unique(fps, return_index=True)
                least, _ = linked(fps, radius, distances[at])
                joined = least != np.arange(len(fps))
                a.append(fps[joined]), b.append(fps[least[joined]])
            a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id (the least doc_id of all that links reach) of every document."""
    rows = written(fingerprints(docs, size), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    # only fingerprints with a link have a row here; every other is a class of its own
    of_class = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_class.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies by similarity: rows of least-hash samples in a key, and keys of a document.
#: At a similarity of 0.8 a document misses all keys of its copy with probability (1 - 0.8**5)**16 = 0.002.
KEY_ROWS, KEYS = 5, 16


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = lambda what: np.array([xxhash.xxh64_intdigest(f"{what} {i}") for i in range(n)], np.uint64)
    return draw("times") | np.uint64(1), draw("plus")


def least_hash_keys(unique: np.ndarray, times: np.ndarray, plus: np.ndarray) -> list[int]:
    """KEYS keys, each of KEY_ROWS least values of independent orders of the run hashes."""
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(unique), 8192):
        part = unique[at : at + 8192]
        least = np.minimum(least, (part[None, :] * times[:, None] + plus[:, None]).min(axis=1))
    return [signed(xxhash.xxh64_intdigest(least[i : i + KEY_ROWS].tobytes(), i)) for i in range(0, len(least), KEY_ROWS)]


def text_hash() -> Column:
    """Tells texts of one doc_id, or of none, apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def described(docs: DataFrame, size: int) -> DataFrame:
    """For each document: hash of its text, content key and fingerprint of its run set, bucket keys, the set (sorted 32-bit run hashes) and its distances to the pivots."""

    def run(batches):
        times, plus = _multipliers(KEYS * KEY_ROWS)
        for batch in batches:
            key, keys, sets, fp, distances = [], [], [], [], []
            for text in batch.column(1):
                unique = np.unique(run_hashes(words_of(text.as_py()), size))
                runs = np.unique((unique >> np.uint64(32)).astype("<u4"))
                fp.append(signed(fingerprint(unique)))
                distances.append(set_distances(runs).tobytes())
                key.append(signed(xxhash.xxh64_intdigest(unique.tobytes())))
                keys.append(least_hash_keys(unique, times, plus))
                sets.append(runs.tobytes())
            arrays = [batch.column(0), batch.column(2), pa.array(key, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary()), pa.array(distances, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "same", "key", "fp", "keys", "runs", "distances"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("same"))
    return rows.mapInArrow(run, "doc_id long, same long, key long, fp long, keys array<long>, runs binary, distances binary")


def set_distances(runs: np.ndarray) -> np.ndarray:
    """Distances of a set of 32-bit run hashes to PIVOTS pivots, each of all hashes with a certain bit, less the pivot's size.

    The symmetric difference of a set and a pivot has the pivot's members, less the set's that are in it, and the set's others.
    """
    return (len(runs) - 2 * bit_sums(runs.astype(np.uint64))[-PIVOTS:]).astype("<i4")


def apart(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the pivot distances ``a`` and ``b`` of pairs of sets, of ``sizes`` together, rule ``similarity`` out.

    Sets of that similarity differ by (1 - similarity) / (1 + similarity) of their sizes together at most, and so do
    their distances to any pivot.
    """
    return np.abs(a - b).max(axis=-1) > (1 - similarity) / (1 + similarity) * sizes + 1e-6


def similar(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sorted run sets; two empty sets are alike."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def block_links(keys: np.ndarray, sets: list[np.ndarray], of: np.ndarray, left: np.ndarray, right: np.ndarray, buckets: np.ndarray, bucket: int, similarity: float, distances: np.ndarray) -> list[tuple[int, int]]:
    """Links of each member in ``left`` to those in ``right`` (masks of two blocks of a bucket, or of one twice).

    ``of`` is the class that a member is joined to so far.  A pair that shares several buckets is compared in the
    first of them only, and of the links found those that join something are given.  ``distances`` has the distances
    to the pivots.
    """
    full = np.flatnonzero([len(s) > 0 for s in sets])  # an empty set is like no other
    while len(full) > 1:
        sizes = np.array([len(sets[i]) for i in full])
        values, runs = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        # a similar set has at least this share of a member's runs, and a run that only one member has is in no other
        some = np.add.reduceat(np.bincount(runs)[runs] > 1, starts, dtype=np.int64) >= similarity * sizes
        if some.all():
            break
        full = full[some]
    else:
        return []
    keys, of, left, right, buckets, distances = keys[full], of[full], left[full], right[full], buckets[full], distances[full]
    parent: dict[int, int] = {}

    def find(x):
        while x in parent:
            x = parent[x]
        return x

    out, mine = [], np.zeros(len(values), bool)
    for i in np.flatnonzero(left):
        agree = buckets == buckets[i]
        wanted = right & (of != of[i]) & (buckets[np.arange(len(full)), agree.argmax(axis=1)] == bucket) & (~(left & right) | (keys > keys[i]))
        wanted &= np.minimum(sizes, sizes[i]) / np.maximum(sizes, sizes[i]) >= similarity
        some = np.flatnonzero(wanted)
        wanted[some] = ~apart(distances[some], distances[i], sizes[some] + sizes[i], similarity)
        if not wanted.any():
            continue
        own = runs[starts[i] : starts[i] + sizes[i]]
        mine[own] = True
        both = np.add.reduceat(mine[runs], starts, dtype=np.int64)
        mine[own] = False
        for j in np.flatnonzero(wanted & (both / (sizes + sizes[i] - both) >= similarity)):
            x, y = find(int(of[i])), find(int(of[j]))
            if x != y:
                parent[x] = y
                out.append((int(keys[i]), int(keys[j])))
    return out


def tabled(distances: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(distances.to_pylist()), "<i4").reshape(-1, PIVOTS)


def near_fingerprints(members: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): pairs of ``key`` whose fingerprints ``fp`` are equal or linked, a key for each fingerprint standing for the rest."""
    of_fp = members.groupBy("fp").agg(F.min("key").alias("first"))
    equal = members.join(of_fp, "fp").where(F.col("key") != F.col("first")).select(F.col("key").alias("a"), F.col("first").alias("b"))
    side = lambda name, key: of_fp.select(F.col("fp").alias(name), F.col("first").alias(key))
    near = links(of_fp.select("fp"), radius).toDF("x", "y").join(side("x", "a"), "x").join(side("y", "b"), "y").select("a", "b")
    return equal.unionByName(near)


def links_across(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) for run sets of ``similarity`` or more that share a bucket and that ``roots`` doesn't join.

    A bucket's members outside its largest class are dealt into blocks, and so are those inside it.  Each block of
    the former meets itself and every other block: no pair of two classes is left out.
    """
    placed = members.join(roots, F.col("key") == F.col("node"), "left").select("key", "n", "keys", F.coalesce("root", "key").alias("of"))
    inside = placed.select("key", "of", "n", F.explode("keys").alias("bucket"))
    by_class = inside.groupBy("bucket", "of").agg(F.count("*").alias("rows"), F.sum("n").alias("runs"))
    mixed = by_class.groupBy("bucket").agg(F.max(F.struct("rows", "of", "runs")).alias("most"), F.count("*").alias("classes"), F.sum("rows").alias("rows"), F.sum("runs").alias("runs")).where("classes > 1")
    blocks = lambda rows, runs: F.ceil(F.greatest(rows / STRIP, runs / STRIP_RUNS)).cast("int")
    most, others = blocks(F.col("most.rows"), F.col("most.runs")), blocks(F.col("rows") - F.col("most.rows"), F.col("runs") - F.col("most.runs"))
    mixed = mixed.select("bucket", F.col("most.of").alias("most"), others.alias("others"), (others + most).alias("blocks"))
    some = F.xxhash64("key", "bucket")
    block = F.when(F.col("of") == F.col("most"), F.col("others") + F.pmod(some, F.col("blocks") - F.col("others"))).otherwise(F.pmod(some, F.col("others"))).cast("int")
    dealt = written(inside.join(mixed, "bucket").select("key", "of", "bucket", "others", "blocks", block.alias("block")), "dealt")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    met = dealt.select("key", "of", "bucket", "block", F.explode(F.filter(met, lambda m: m["i"] < F.col("others"))).alias("m")).select("key", "of", "bucket", "block", "m.i", "m.j")

    def compare(t: pa.Table) -> pa.Table:
        of_block = t["block"].to_numpy()
        sets = [np.frombuffer(r.as_py(), "<u4") for r in t["runs"]]
        left, right = of_block == t["i"][0].as_py(), of_block == t["j"][0].as_py()
        found = block_links(t["key"].to_numpy(), sets, t["of"].to_numpy(), left, right, np.array(t["keys"].to_pylist(), np.int64), t["bucket"][0].as_py(), similarity, tabled(t["distances"]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return met.join(sets, "key").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, same (hash of the text), key (of the run set), root and component_id for every document, linking run sets of ``similarity`` or more.

    Equal sets share a key and cost one row.  Sets of near fingerprints are candidates first.  In a bucket each member is first tried with two leaders, drawn anew in
    each of the KEYS buckets it is in; what they leave in several classes is compared by :func:`links_across`.
    """
    described_rows = rows = written(described(docs, size), "described")
    distinct = rows.groupBy("key").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp"), (F.first(F.length("runs")) / 4).cast("long").alias("n"), F.min("doc_id").alias("least"))
    members = written(distinct, "members")
    near = written(near_fingerprints(members), "near")
    inside = members.select("key", "n", F.posexplode("keys").alias("number", "bucket"))
    draw = F.struct(F.xxhash64("key", "number").alias("draw"), "key", "n")
    leaders = inside.groupBy("number", "bucket").agg(F.min(draw).alias("first"), F.max(draw).alias("last")).where(F.col("first.key") != F.col("last.key"))
    leaders = leaders.select("number", "bucket", F.explode(F.array("first", "last")).alias("leader"))
    tried = inside.join(leaders, ["number", "bucket"]).where(F.col("key") != F.col("leader.key"))
    # sets of sizes further apart than this can't be alike
    tried = tried.where(F.least("n", "leader.n") / F.greatest("n", "leader.n") >= similarity)
    tried = tried.select("key", F.col("leader.key").alias("other")).unionByName(near.toDF("key", "other"))
    pairs = written(tried.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct(), "pairs")
    met = inside.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    wanted = inside.join(met, "bucket", "left_semi").select("key").unionByName(near.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    # copies become one row before the shuffle, so that a large group of them doesn't meet in one task; from here on
    # only the sets that share a bucket with another, or have a near fingerprint, are moved
    sets = written(rows.groupBy("key").agg(F.first("runs").alias("runs"), F.first("keys").alias("keys"), F.first("distances").alias("distances")).join(wanted, "key", "left_semi"), "sets")
    rows = written(rows.select("doc_id", "same", "key"), "keys")
    dropped(described_rows)
    runs_of = lambda side: sets.select(F.col("key").alias(side), F.col("runs").alias(f"runs_{side}"), F.col("distances").alias(f"distances_{side}"))
    both = pairs.join(runs_of("a"), "a").join(runs_of("b"), "b")

    def verify(batches):
        for batch in batches:
            sizes = np.array([(len(x.as_py()) + len(y.as_py())) // 4 for x, y in zip(batch.column(2), batch.column(3))], np.int64)
            left = batch.filter(pa.array(~apart(tabled(batch.column(4)), tabled(batch.column(5)), sizes, similarity)))
            ok = [similar(x.as_py(), y.as_py()) >= similarity for x, y in zip(left.column(2), left.column(3))]
            yield pa.RecordBatch.from_arrays([left.column(0), left.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    roots = components(both.select("a", "b", "runs_a", "runs_b", "distances_a", "distances_b").mapInArrow(verify, "a long, b long"))
    across = written(links_across(members, roots, sets, similarity), "across")
    dropped(pairs, sets, near)
    if not across.isEmpty():
        first, roots = roots, components(roots.toDF("a", "b").unionByName(across))
        dropped(first)
    of_class = members.select("key", "least").join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(of_class.join(least, "root").select("key", "root", "component_id"), "classes")
    dropped(members, roots, across)
    return rows.join(named, "key")


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of ``docs``: that of the least doc_id, and of its texts the one with the least hash.

    A class whose doc_ids are all null keeps one of its rows, and rows that repeat doc_id and text are one.
    """
    classed = near_copies(docs, size, similarity).groupBy("root", "doc_id", "same").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", "rows")).alias("first")
    own, text, times = (free(docs, name) for name in ("__id", "__same", "__rows"))
    kept = written(classed.groupBy("root").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.same").alias("same"), F.col("first.rows").alias(times)), "kept")
    named = docs.withColumns({own: F.col("doc_id").cast("long"), text: text_hash()})
    same = (F.col(f"d.{text}") == F.col("k.same")) & F.col(f"d.{own}").eqNullSafe(F.col("k.id"))
    stay = lambda rows: named.alias("d").join(rows.alias("k"), same, "left_semi")
    if kept.where(F.col(times) > 1).isEmpty():  # then texts are shuffled once
        return stay(kept).select(*docs.columns)
    once = stay(kept.where(F.col(times) > 1)).dropDuplicates([own, text])
    return stay(kept.where(F.col(times) == 1)).unionByName(once).select(*docs.columns)
