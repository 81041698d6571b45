"""Language identification by nearest centroid.

A text is a vector of hashed n-grams (1 to 3 characters of its lower-cased letters, words set off by blanks),
weighted by TF-IDF and normalised.  Each language has several centroids, clustered by spherical k-means; the
nearest centroid by cosine names the language, and its cosine is the score.  A text further from every centroid
than held-out training texts and pieces of its length is *rejected*: it isn't in any learned language.  They are
held out by halves: each half is scored by centroids of the other.

Document frequencies are those of all documents that may be learned from; centroids and floors come from at most
``SAMPLE`` of each language, chosen by a hash of doc_id.  Only text is read; language, source and id are never inputs of a prediction.

Cases: text that is null or without a letter is ``und`` with score 0; texts of any length are read whole;
repeated rows repeat; of equal cosines the centroid of the alphabetically first language wins; other columns are ignored; an empty table, or one without a labelled row, predicts ``und``.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import memory_returned, remainder

#: Documents of each language that are learned from, at most; buckets of hashed n-grams; centroids of a language.
SAMPLE, WIDTH, CENTROIDS = 500, 4096, 4
#: A text is rejected below this part of a low quantile of the cosines of held-out pieces of its length, and of whole
#: texts at most, as some long ones are a word or two over and over.
SLACK, LOW = 0.75, 0.02
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return None
    code = np.where(is_letter, code, 32).astype(np.uint64)
    keep = np.r_[True, is_letter[1:] | is_letter[:-1]] & (is_letter | (np.arange(len(code)) > 0))
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint64)
    letter = code != 32
    out = np.bincount(_bucket(code[letter], 1), minlength=WIDTH)
    two = code[:-1] * np.uint64(0x9E3779B1) + code[1:] * np.uint64(0x85EBCA77)
    out += np.bincount(_bucket(two[letter[:-1] | letter[1:]], 2), minlength=WIDTH)
    three = two[:-1] * np.uint64(0xC2B2AE3D) + code[2:] * np.uint64(0x27D4EB2F)
    return out + np.bincount(_bucket(three[letter[1:-1]], 3), minlength=WIDTH)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(52)).astype(np.int64)


def length_bin(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(total, 1)).astype(int), 15)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (rows, WIDTH), each of length 1
    owner: np.ndarray  # index of the language of each row
    floor: np.ndarray  # least cosine accepted, by length bin

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        """Rows of counts weighted and of length 1; some at a time, so that little but the result is held."""
        out = np.empty(raw.shape, np.float32)
        for at in range(0, len(raw), 256):
            x = np.log1p(raw[at : at + 256].astype(np.float32)) * self.idf
            out[at : at + 256] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        found = ((i, c) for i, t in enumerate(texts) if (c := counts(t)) is not None)
        while part := list(itertools.islice(found, 256)):  # a vector is long: few are held at a time
            raw = np.stack([c for _, c in part]).astype(np.float32)
            cosine = self.vectors(raw) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(part)), best]
            rejected = top < self.floor[length_bin(raw.sum(axis=1))]
            for (i, _), b, s, r in zip(part, best, top, rejected):
                out[i] = (self.languages[self.owner[b]], float(min(1.0, max(0.0, s))), bool(r))
        return out


def k_means(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means from the mean and then the rows furthest from what is chosen; no randomness."""
    mean = x.mean(axis=0)
    chosen = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[(x @ np.stack(chosen).T).max(axis=1).argmin()])
    c = np.stack(chosen)
    for _ in range(steps):
        of = (x @ c.T).argmax(axis=1)
        new = np.stack([x[of == j].sum(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def learned(model: Model, x: np.ndarray, y: np.ndarray, k: int) -> Model:
    rows = [k_means(x[y == i], k) for i in np.unique(y)]
    model.centroids = np.concatenate(rows).astype(np.float32)
    model.owner = np.repeat(np.unique(y), [len(r) for r in rows])
    return model


def fit(raw: np.ndarray, labels: list[str], pieces: np.ndarray, seen: np.ndarray, k: int = CENTROIDS) -> Model:
    """A model of documents; ``seen`` has how many documents there are in all and with each n-gram, ``pieces`` has the counts of a piece of each, of lengths from a word to the whole."""
    languages = sorted(set(labels))
    model = Model(languages, np.ones(WIDTH, np.float32), np.zeros((0, WIDTH), np.float32), np.zeros(0, int), np.zeros(16))
    if not languages:
        return model
    model.idf = (np.log((1 + seen[0]) / (1 + seen[1:])) + 1).astype(np.float32)
    x, y = model.vectors(raw), np.array([languages.index(v) for v in labels])
    half = np.arange(len(x)) % 2
    whole, part = np.zeros(len(x)), np.zeros(len(x))
    for h in range(2):
        mine = half == h if (half != h).any() else half != h
        if mine.any():
            learned(model, x[~mine], y[~mine], k)
            whole[mine] = (x[mine] @ model.centroids.T).max(axis=1)
            part[mine] = (model.vectors(pieces[mine]) @ model.centroids.T).max(axis=1)
    learned(model, x, y, k)
    bins = length_bin(np.r_[raw.sum(axis=1), pieces.sum(axis=1)])
    cosines = np.r_[whole, part]
    low = np.array([np.quantile(cosines[bins == b], LOW) if (bins == b).any() else np.inf for b in range(16)])
    least = np.minimum(np.minimum.accumulate(low[::-1])[::-1], np.quantile(whole, LOW))
    model.floor = least * SLACK  # no shorter text is judged more strictly than a longer one
    return model


def piece(text: str) -> str:
    """Some words of a text, a power of two of them: lengths and places are drawn by its hash."""
    words = text.split()
    draw = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    size = min(len(words), 1 << draw % 9)
    at = draw // 9 % (len(words) - size + 1)
    return " ".join(words[at : at + size])


def frequency_rows(known: DataFrame) -> DataFrame:
    """at, n: the number of texts with a letter (at 0), and of those with each n-gram, summed over all partitions by the executors."""

    def run(batches):
        seen = np.zeros(1 + WIDTH, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (c := counts(text.as_py())) is not None:
                    seen += np.r_[1, c > 0]
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.list_(pa.int64()))], names=["seen"])

    parts = known.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "seen array<long>")
    return parts.select(F.posexplode("seen").alias("at", "n")).where("n > 0").groupBy("at").agg(F.sum("n").alias("n"))


def document_frequencies(known: DataFrame) -> np.ndarray:
    """The sums of :func:`frequency_rows`, of which there are 1 + WIDTH at most, whatever the partitions."""
    seen = np.zeros(1 + WIDTH, np.int64)
    for r in frequency_rows(known).collect():
        seen[r["at"]] = r["n"]
    return seen


def train(docs: DataFrame, bound: int = SAMPLE) -> Model:
    """Centroids from the documents that may be learned from; a text that repeats under an id is drawn once at most."""
    known = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    draw = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"), F.lit(5))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    condition = F.lit(False)
    for lang, n in sizes.items():
        condition = condition | ((F.col("lang") == lang) & (F.pmod(draw, F.lit(1_000_000)) < int(1_000_000 * min(1.0, bound / n)) + 1))

    def binary(c):
        return zlib.compress(np.minimum(c, 65535).astype("<u2").tobytes(), 1)  # most are zeros, and all of them pass the driver

    def run(batches):
        for batch in batches:
            found = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (c := counts(text)) is not None:
                    some = counts(piece(text))
                    found.append((binary(c), binary(c if some is None else some), lang))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.string()))], names=["raw", "piece", "lang"])

    chosen = known.where(condition).select(F.col("text").cast("string").alias("text"), "lang", draw.alias("draw")).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    rows = chosen.select("text", "lang").mapInArrow(run, "raw binary, piece binary, lang string").collect()
    raw, pieces, labels = in_order([r.raw for r in rows], [r.piece for r in rows], [r.lang for r in rows])
    del rows
    model = fit(raw, labels, pieces, document_frequencies(known))
    del raw, pieces
    memory_returned()
    return model


def in_order(raw: list[bytes], pieces: list[bytes], labels: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The counts of compressed rows, sorted by label and counts; the bytes of two rows at a time are held beside the result."""
    tables = []
    for column in (raw, pieces):
        tables.append(np.empty((len(column), WIDTH), "<u2"))
        for i, x in enumerate(column):
            tables[-1][i] = np.frombuffer(zlib.decompress(x), "<u2")

    def compared(i: int, j: int) -> int:
        a, b = ((labels[k], *(t[k].tobytes() for t in tables)) for k in (i, j))
        return (a > b) - (a < b)

    order = sorted(range(len(labels)), key=functools.cmp_to_key(compared))
    return tables[0][order], tables[1][order], [labels[i] for i in order]


def predictions(docs: DataFrame, model: Model, name: str = "found") -> DataFrame:
    """All columns of ``docs`` with ``name``: struct of lang_pred, score and rejected."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts):
        import pandas as pd

        out = pd.DataFrame(handle.value.predict(list(texts)), columns=["lang_pred", "score", "rejected"])
        memory_returned()
        return out

    return docs.withColumn(name, predict(F.col("text").cast("string")))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document: what is rejected is in no learned language, ``lang_pred`` is the nearest."""
    model = train(docs)
    rows = predictions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")
