"""Homomorphic multiset hash of a document's paragraphs, with SQL functions alone.

A paragraph is hashed to a wide vector of integers, and a document's vector is the sum over its paragraphs,
each lane modulo a power of two.  The sum doesn't depend on the order of paragraphs, and a paragraph is
inserted or deleted by adding or subtracting its vector (:func:`combined`), with no look at the others.

A paragraph's vector has two parts.  ``STRONG`` lanes modulo 2**32 come from the hash of the whole paragraph:
they decide equality.  The others, modulo 2**31, are the number of the paragraph's word triples and, for each bit of
two hashes, how many of them have the bit set (two lanes to an integer, so that one addition serves both): these
give random-sign projections of the multiset of triples, whose cosine is the likeness of two documents.  Both parts
are functions of the paragraph, so the whole vector stays additive.  A fingerprint is the whole vector as text
(:func:`shown`), and a likeness is worked out from two fingerprints alone (:func:`read`, :func:`likeness`).

Paragraphs are lines; empty lines count as paragraphs too, so the texts 'a' and 'a\n' differ.  A document
is one shuffled row: neighbours are found by ranges of doc_id, so that no task holds more than a range.

Cases: null text is empty, with one empty paragraph; equal texts have equal fingerprints, and a text against
itself likeness 1; two texts without any triple are alike 1 if equal, else 0; the last document's next is the
first (one document alone: itself); a null doc_id comes last in descending order; repeated doc_ids are
ordered by their text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRONG = 8  # lanes of 32 bits
SEEDS = 2  # hashes of a word triple, 32 integers of two lanes for each
SOFT = 32 * SEEDS
PAIR = 0x0000_0001_0000_0001
LANE = 0xFFFF_FFFF
COUNT = 0x7FFF_FFFF  # a lane that counts triples
COUNTS = COUNT << 32 | COUNT
#: Characters of text that one range of documents should hold.
RANGE_CHARS = 8_000_000
#: Quantiles of doc_id that the driver holds at most.
SEGMENTS = 256
#: Ranges up to which one small row of each is broadcast: a choice of plan, whose results are the same.
MOST_BROADCAST = 100_000


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strong_hashes(paragraph: Column) -> list[Column]:
    """Lanes of one paragraph: the halves of differently seeded hashes."""
    wide = [F.xxhash64(F.lit(seed), paragraph) for seed in range(STRONG // 2)]
    return [lane for h in wide for lane in (h.bitwiseAND(F.lit(LANE)), F.shiftrightunsigned(h, 32))]


def triples(text: Column) -> Column:
    """Hashes of the word triples of each paragraph (of all its words, if under three)."""

    def of(words: Column) -> Column:
        n = F.size(words)
        spread = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
        return F.when(n > 0, spread).otherwise(F.array().cast("array<bigint>"))

    words = lambda p: F.filter(F.split(p, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.flatten(F.transform(paragraphs(text), lambda p: F.get(F.transform(F.array(words(p)), of), F.lit(0))))


def strong_sums(text: Column) -> Column:
    """STRONG lanes of a text, as an array."""
    zero = F.array(*[F.lit(0).cast("long")] * STRONG)

    def add(acc: Column, p: Column) -> Column:
        return F.array(*[(F.get(acc, F.lit(i)) + lane).bitwiseAND(F.lit(LANE)) for i, lane in enumerate(strong_hashes(p))])

    return F.aggregate(paragraphs(text), zero, add)


def soft_aggregates(h: Column) -> list[Column]:
    """Sums over rows of word-triple hashes."""
    out = []
    for seed in range(SEEDS):
        x = h if seed == 0 else F.when(h.isNotNull(), F.xxhash64(h))  # the hash of a null is a number
        out += [F.sum(F.shiftrightunsigned(x, bit).bitwiseAND(F.lit(PAIR))) for bit in range(32)]
    return out


def lanes(packed: Column, n: Column) -> Column:
    """Random-sign projections: 2 * (triples with the bit) - triples, for both lanes of each integer."""
    signed = lambda x: (2 * x - n).cast("double")
    return F.concat(F.transform(packed, lambda x: signed(F.shiftrightunsigned(x, 32))), F.transform(packed, lambda x: signed(x.bitwiseAND(F.lit(LANE)))))


def cosine(a: Column, b: Column) -> Column:
    def total(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)

    norm = F.sqrt(total(a, a) * total(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(a, b) / norm))).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, for two fingerprint structs."""
    return F.when(a["hex"] == b["hex"], 1.0).otherwise(cosine(lanes(a["soft"], a["n"]), lanes(b["soft"], b["n"])))


def shown(strong_hex: Column, n: Column, soft: Column) -> Column:
    """A fingerprint: 8 hex digits for each strong lane and for the number of triples, 16 for each pair of other lanes."""
    digits = lambda x, k: F.lower(F.lpad(F.hex(x), k, "0"))
    return F.concat(strong_hex, digits(n, 8), F.array_join(F.transform(soft, lambda x: digits(x, 16)), ""))


def read(fingerprint: Column) -> Column:
    """The lanes of a fingerprint: struct of hex, n and soft."""
    number = lambda start, k: F.conv(F.substr(fingerprint, start, F.lit(k)), 16, 10).cast("long")
    at = 8 * STRONG
    soft = F.transform(F.sequence(F.lit(0), F.lit(SOFT - 1)), lambda i: number(i * 16 + at + 9, 16))
    return F.struct(F.substr(fingerprint, F.lit(1), F.lit(at)).alias("hex"), number(F.lit(at + 1), 8).alias("n"), soft.alias("soft"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The strong lanes of a document with the paragraphs of ``b`` inserted (deleted with ``sign`` -1)."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(LANE)))


def hexed(strong: Column) -> Column:
    return F.array_join(F.transform(strong, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) with ``bucket``: consecutive ranges of doc_id of about RANGE_CHARS characters; and their number.

    Up to SEGMENTS approximate quantiles of doc_id come to the driver; a segment between two of them is divided
    evenly where more ranges are needed, so their number may grow with the table.
    """
    n, chars, low = docs.agg(F.count("*"), F.sum(F.length("text")), F.min("doc_id")).first()
    wanted = max(1, min(n, -(-(chars or 0) // RANGE_CHARS)))
    if wanted == 1 or low is None:
        return docs.withColumn("bucket", F.lit(0).cast("long")), 1
    segments = min(wanted, SEGMENTS)
    parts = -(-wanted // segments)
    quantiles = docs.agg(F.percentile_approx("doc_id", [i / segments for i in range(1, segments + 1)], 100 * segments)).first()[0]
    tops = sorted(set(quantiles))
    bottoms = [low - 1, *tops[:-1]]

    def segment(lo: int, hi: int) -> Column:
        """A binary search, so that a row costs the logarithm of the number of segments."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= F.lit(tops[mid]), segment(lo, mid)).otherwise(segment(mid + 1, hi))

    rows = docs.withColumn("segment", segment(0, len(tops) - 1))
    at = lambda xs: F.get(F.array(*[F.lit(x).cast("double") for x in xs]), F.col("segment"))
    share = (F.col("doc_id") - at(bottoms)) / (at(tops) - at(bottoms)) if parts > 1 else F.lit(0.0)
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.ceil(share * parts) - 1))
    bucket = F.when(F.col("doc_id").isNotNull(), F.col("segment") * parts + part)
    return rows.withColumn("bucket", F.coalesce(bucket, F.lit(-1)).cast("long")).drop("segment"), len(tops) * parts + 1


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, bucket, place, guest: the next document in descending order of doc_id.

    The first row of the range below each range is added to it as a guest, so that a window within the range
    finds every neighbour.  Only the numbers of the ranges are ordered as a whole.
    """
    rows, n = ranges(docs)
    rows = rows.withColumn("guest", F.lit(False))
    tops = rows.groupBy(F.col("bucket").alias("of")).agg(F.max("doc_id").alias("top"))
    if n <= MOST_BROADCAST:  # one row a range at most; else their texts are found by a shuffle
        tops = F.broadcast(tops)
    highest = rows.join(tops, (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = highest.groupBy("bucket", "doc_id").agg(F.max("text").alias("text"))
    above = F.lag("bucket").over(Window.partitionBy(F.lit(0)).orderBy(F.col("bucket").desc()))
    lowest = F.min("bucket").over(Window.partitionBy(F.lit(0)))
    hosts = rows.select("bucket").distinct().select("bucket", F.coalesce(above, lowest).alias("host"))
    guests = heads.join(hosts, "bucket").select("doc_id", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    both = rows.select("doc_id", "text", "bucket", "guest").unionByName(guests)
    return both.select("doc_id", "text", F.lead("text").over(w).alias("next_text"), "bucket", F.row_number().over(w).alias("place"), "guest")


def edited(text: Column, after: Column) -> Column:
    """The last third of ``text`` replaced by as many code points from the start of ``after``."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - k), F.substr(after, F.lit(1), k))


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and likeness to that and to the next document.

    Whole texts are shuffled once, by range; hashes of triples are summed where their document lies.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts)
    rows = rows.withColumn("edited", F.when(~F.col("guest"), edited(F.col("text"), F.col("next_text"))))
    keys = ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256", "strong", "edited_strong"]
    described = rows.select(
        "bucket", "place", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha256"),
        F.unhex(hexed(strong_sums(F.col("text")))).alias("strong"), F.when(~F.col("guest"), F.unhex(hexed(strong_sums(F.col("edited"))))).alias("edited_strong"),
        F.array(triples(F.col("text")), F.when(~F.col("guest"), triples(F.col("edited")))).alias("both"),
    )
    one = described.select(*keys, F.posexplode_outer("both").alias("which", "hashes")).select(*keys, "which", F.explode_outer("hashes").alias("h"))
    packed = F.array(*[F.coalesce(s, F.lit(0).cast("long")).bitwiseAND(F.lit(COUNTS)) for s in soft_aggregates(F.col("h"))])
    sums = one.groupBy(*keys, "which").agg(F.count("h").bitwiseAND(F.lit(COUNT)).alias("n"), packed.alias("soft"))
    struct = lambda hex_col: F.struct(F.col(hex_col).alias("hex"), "n", "soft")
    pair = sums.groupBy(*keys).agg(
        F.max(F.when(F.col("which") == 0, struct("strong"))).alias("own"), F.max(F.when(F.col("which") == 1, struct("edited_strong"))).alias("changed")
    )
    w = Window.partitionBy("bucket").orderBy("place")
    found = pair.withColumn("next", F.lead("own").over(w))
    return found.where(~F.col("guest")).select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        *[shown(F.lower(F.hex(c)), F.col(f"{side}.n"), F.col(f"{side}.soft")).alias(name) for c, side, name in (("strong", "own", "fingerprint"), ("edited_strong", "changed", "edited_fingerprint"))],
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
