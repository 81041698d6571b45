"""Toxicity by a weighted finite-state pattern grammar over clauses.

The words of a clause are read as symbols: insult, threat, target, negation, reported speech, other.  A cascade of
transducers reads them, each the output of the one before: ``NEGATION`` marks insults and threats that stand
shortly after a negator, ``REPORT`` those that a verb of saying introduces, ``TARGET`` those in a clause that has named
somebody, and the last, made from the model, turns marked symbols into factors.  :func:`composed` joins them into
one machine, whose states are pairs of theirs, built as they are met.  A document's score comes from the clauses that
match, not from single words: sum and maximum of clause scores, and how many there are, go through a logistic function.

What is learned from labelled rows: the insult lexicon (words and word stems far commoner in toxic documents,
with their log odds as weights), the factors of the marks (maximum likelihood about a prior), and the logistic function,
all on at most ``SAMPLE`` documents of each label, chosen by a hash, near copies counted once.  The closed classes are
fixed lists in four languages.  Only text is read; language, source and id are never inputs.

Cases: null text is empty and scores as a text without a match; texts of any length are read to their end;
repeated rows repeat; of rows that share an id the least text is learned from, and an id with both labels counts as
toxic; of near copies the least id is learned from, so ties and the order of rows change nothing; other columns are
ignored; an empty table gives an empty result; without labels of both kinds the lexicon is empty and every score is
the prior.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import memory_returned, remainder, written

#: Documents of each label that are learned from, at most.
SAMPLE = 2500
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: A lexicon entry is so much commoner in toxic documents (log odds), by so clear a log-likelihood ratio.
LEAST_LOG_ODDS, LEAST_G2 = 2.5, 30.0
#: A text of more different words than this is a lesser witness for each, as a long text has any word by chance.
WITNESS_WORDS = 200
#: A stem stands for a family of words: surer, and in this many times the documents of its commonest entry.
STEM_LOG_ODDS, STEM_FAMILY = 1.75, 1.5

# Closed classes of the grammar, in English, German, French and Spanish.
THREATS = frozenset("kill kills murder destroy hurt burn beat stab shoot hang töten umbringen verprügeln vernichten tuer frapper brûler détruire matar golpear quemar destruir".split())
TARGETS = frozenset("you your yours yourself they them their he him she her people all everyone du dich dir dein ihr euch sie ihn tu te toi vous ton votre ils elles lui tú ti usted ustedes vosotros ellos ellas".split())
NEGATIONS = frozenset("not never no nobody nothing without hardly isn aren wasn don doesn didn nicht nie kein keine keiner niemals ohne pas jamais rien sans aucun nunca jamás sin ningún nada".split())
REPORTS = frozenset("said says say claimed claims wrote called reported quoted quote according allegedly sagte sagt schrieb nannte laut angeblich dit disait écrit selon prétend dijo dice escribió llamó según".split())

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
BREAKS = frozenset(".!?;:\n")


@dataclass(frozen=True)
class Transducer:
    """``arcs``: (state, symbol) -> (state, symbol put out, factor).  A missing arc puts out what it read, with factor 1, and goes to ``rest`` of the state."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol, 1.0)


class Composition:
    """The second transducer reads what the first puts out: states are pairs, factors multiply.  Built lazily."""

    def __init__(self, first, second):
        self.first, self.second = first, second
        self.numbers, self.states = {(0, 0): 0}, [(0, 0)]
        self.arcs: dict[tuple[int, str], tuple[int, str, float]] = {}

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            a, b = self.states[state]
            a, between, w = self.first.step(a, symbol)
            b, out, v = self.second.step(b, between)
            if (a, b) not in self.numbers:
                self.numbers[a, b] = len(self.states)
                self.states.append((a, b))
            arc = self.arcs[state, symbol] = self.numbers[a, b], out, w * v
        return arc


def composed(*parts):
    return functools.reduce(Composition, parts)


# symbols: I insult, H threat, T target, N negation, R report, O other; marks put after I and H: n, r, t
MARKS = "nrt"


def marked(so_far: str, mark: str, state: int, to: int) -> dict[tuple[int, str], tuple[int, str, float]]:
    """Arcs that put ``mark`` on insults and threats with any of the marks ``so_far``."""
    kinds = [x + "".join(m) for x in "IH" for k in range(len(so_far) + 1) for m in itertools.combinations(so_far, k)]
    return {(state, x): (to, x + mark, 1.0) for x in kinds}


NEGATION = Transducer({**{(s, "N"): (3, "N", 1.0) for s in range(4)}, **marked("", "n", 3, 2), **marked("", "n", 2, 1), **marked("", "n", 1, 0)}, {3: 2, 2: 1, 1: 0})
REPORT = Transducer({(0, "R"): (1, "R", 1.0), **marked("n", "r", 1, 1)})
TARGET = Transducer({(0, "T"): (1, "T", 1.0), **marked("nr", "t", 1, 1)})
#: Every symbol that can carry weight after the marks: insults, then threats.
CLASSES = [x + "".join(m for i, m in enumerate(MARKS) if k >> i & 1) for x in "IH" for k in range(8)]
MARKING = composed(NEGATION, REPORT, TARGET)

#: Prior of the factors: negated, reported, addressed; weight of a threat, and its factor where nobody is addressed.
PRIOR = {"n": 0.4, "r": 0.6, "t": 1.5, "threat": 2.0, "bare": 0.25}
#: Standard deviation of the logarithm of a factor about its prior, and the steps of it that are tried.
FACTOR_SPREAD, FACTOR_STEPS = 0.5, (-2, -1, -0.5, 0.5, 1, 2)


def class_factors(factors: dict[str, float]) -> dict[str, float]:
    """The factor of each marked symbol."""
    return {c: math.prod(factors[m] for m in c[1:]) * (factors["threat"] * (1.0 if "t" in c else factors["bare"]) if c[0] == "H" else 1.0) for c in CLASSES}


def weighing(factors: dict[str, float]) -> Transducer:
    """The last of the cascade: puts out the bare symbol with its factor."""
    return Transducer({(0, c): (0, c[0], f) for c, f in class_factors(factors).items()})


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    factors: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    bias: float = 0.0
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        lengths = {min(map(len, [*self.words, *self.stems, *THREATS]), default=4), 4}
        self.cut = min(lengths)
        #: first letters of every entry: one test tells that a token can't match
        self.heads = {w[: self.cut] for w in (*self.words, *self.stems, *THREATS)}
        self.grammar = composed(MARKING, weighing(self.factors))

    def weight(self, token: str) -> float:
        w = self.words.get(token)
        if w is None:
            w = max((self.stems.get(token[:n], 0.0) for n in STEM_LENGTHS), default=0.0)
        return w


def symbol_of(token: str, model: Model) -> tuple[str, float]:
    w = model.weight(token)
    if w > 0:
        return "I", w
    if token in THREATS:
        return "H", 1.0
    if token in TARGETS:
        return "T", 0.0
    if token in NEGATIONS:
        return "N", 0.0
    return ("R", 0.0) if token in REPORTS else ("O", 0.0)


def matches(text: str, model: Model, machine) -> list[list[tuple[str, str, float]]]:
    """(word, symbol put out, weight times factor) of the insults and threats of each clause that has some."""
    tokens = TOKEN.findall(text.lower())
    heads, cut = model.heads, model.cut
    hits = [i for i, t in enumerate(tokens) if t[:cut] in heads]
    if not hits or not any(symbol_of(tokens[i], model)[0] in "IH" for i in hits):
        return []
    out, done = [], -1
    for hit in hits:
        if hit <= done:
            continue
        start = hit
        while start > 0 and tokens[start - 1] not in BREAKS:
            start -= 1
        state, found, i = 0, [], start
        while i < len(tokens) and tokens[i] not in BREAKS:
            symbol, w = symbol_of(tokens[i], model)
            state, symbol, factor = machine.step(state, symbol)
            if w > 0:
                found.append((tokens[i], symbol, w * factor))
            i += 1
        done = i
        if found:
            out.append(found)
    return out


def clauses(text: str, model: Model) -> list[tuple[float, list[str]]]:
    """(score, matched words) of each clause that the grammar matches."""
    found = [(sum(w for *_, w in c), [t for t, *_ in c]) for c in matches(text, model, model.grammar)]
    return [c for c in found if c[0] > 0]


def class_sums(text: str | None, model: Model) -> np.ndarray:
    """For each clause that matches: the weights of its words by marked symbol."""
    found = matches(text or "", model, MARKING)
    out = np.zeros((len(found), len(CLASSES)))
    for row, clause in zip(out, found):
        for _, symbol, w in clause:
            row[CLASSES.index(symbol)] += w
    return out


def features(text: str | None, model: Model) -> tuple[float, float, float]:
    """log of the sum of clause scores, log of the largest, log of their number (each plus 1)."""
    found = [s for s, _ in clauses(text or "", model)]
    return math.log1p(sum(found)), math.log1p(max(found, default=0.0)), math.log1p(len(found))


def probability(x: tuple[float, float, float], model: Model) -> float:
    z = model.bias + sum(a * b for a, b in zip(x, model.coef))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


#: Least hashes of a text, and how many two near copies share: 3 of 16 is a similarity of about a fifth, as texts that
#: share a passage are one witness for its words.
SIGNATURE, SHARED = 16, 3


def signature(text: str) -> bytes:
    """The least hashes of the text's five-word runs in SIGNATURE orders: near copies share many of them."""
    words = text.split()
    runs = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
    times = np.array([xxhash.xxh64_intdigest(f"order {i}") | 1 for i in range(SIGNATURE)], np.uint64)
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(runs), 8192):
        least = np.minimum(least, (runs[at : at + 8192, None] * times).min(axis=0))
    return least.tobytes()


def first_of_near_copies(signatures: np.ndarray) -> np.ndarray:
    """Places of the rows that agree with no earlier row, directly or through others, in SHARED places of their signature."""
    root = np.arange(len(signatures))
    for at in range(0, len(signatures), 64):
        alike = (signatures[at : at + 64, None] == signatures[None]).sum(axis=2) >= SHARED
        for i, j in zip(*np.nonzero(alike)):
            low, high = sorted((root[i + at], root[j]))
            if low != high:
                root[root == high] = low
    return np.flatnonzero(root == np.arange(len(root)))


def _vocabulary(batches):
    """For each word and stem of the sample, and for all (the entry ""): documents of either label that have it, in thousandths, summed in the partition."""
    counts: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(1), batch.column(2).to_pylist()):
            words = {w for w in TOKEN.findall((text.as_py() or "").lower()) if len(w) > 2}
            share = round(1000 * min(1.0, WITNESS_WORDS / max(len(words), 1)))  # whole numbers add up alike in any order
            for w in words | {""} | {"^" + w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}:
                counts[w, toxic] += share
    if counts:
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["entry", "toxic", "n"])


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """id, text and toxic of at most ``bound`` learning documents of each label, near copies once."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")).where(remainder(F.col("id"), 5) != 0)
    counts = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    rank = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, bound / max(counts.get(1, 0), 1)).otherwise(bound / max(counts.get(0, 0), 1))
    few = chosen.where(rank < share * 1_000_000)
    # ``few`` is bounded by ``bound`` rows of each label, give or take the hash; an id has one text here
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(few), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))

    def sign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([signature(t.as_py()) for t in batch.column(2)], pa.binary())], names=["id", "toxic", "text", "signature"])

    signed = written(texts.mapInArrow(sign, "id long, toxic int, text string, signature binary"), "toxicity")
    rows = sorted((r.toxic, r.id, bytes(r.signature)) for r in signed.select("toxic", "id", "signature").collect())
    kept = []
    for label in (0, 1):
        own = [r for r in rows if r[0] == label]
        kept += [(own[i][1],) for i in first_of_near_copies(np.frombuffer(b"".join(r[2] for r in own), np.uint64).reshape(-1, SIGNATURE))]
    return signed.select("id", "text", "toxic").join(F.broadcast(docs.sparkSession.createDataFrame(kept, "id long")), "id", "left_semi")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression the rarer label weighted by the root of what would even them; the bias comes last."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.sqrt(np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y))
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge * len(y) / 10
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    texts = sample(docs, labels, bound)
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model({}, {}, bias=-4.0 if not toxic else 0.0)
    counted = texts.mapInArrow(_vocabulary, "entry string, toxic int, n long").groupBy("entry").agg(
        (F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)) / 1000).alias("a"), (F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)) / 1000).alias("b")
    )
    counted = written(counted, "entries")
    toxic, clean = counted.where("entry = ''").select("a", "b").first()
    counted = counted.where("entry <> ''")
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    part = toxic / (toxic + clean)
    log_ratio = lambda n, p: F.when(n > 0, n * (F.log(n / (F.col("a") + F.col("b"))) - math.log(p))).otherwise(0.0)
    g2 = 2 * (log_ratio(F.col("a"), part) + log_ratio(F.col("b"), 1 - part))
    # an entry needs a number of documents of a bounded sample, so the lexicon is bounded too
    kept = counted.where((odds >= F.when(F.col("entry").startswith("^"), STEM_LOG_ODDS).otherwise(LEAST_LOG_ODDS)) & (g2 >= LEAST_G2)).select("entry", "a", odds.alias("odds")).collect()
    words = {r.entry: r for r in kept if r.entry[0] != "^"}
    member = Counter()
    for w, r in words.items():
        for n in STEM_LENGTHS:
            member[w[:n]] = max(member[w[:n]], r.a)
    stems = {r.entry[1:]: r.odds for r in kept if r.entry[0] == "^" and r.odds >= STEM_LOG_ODDS and r.a >= STEM_FAMILY * member[r.entry[1:]]}
    model = Model({w: r.odds for w, r in words.items()}, stems)

    def run(batches):
        for batch in batches:
            rows = [class_sums(t.as_py(), model).reshape(-1).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["id", "toxic", "sums"])

    seen = sorted((r.id, r.toxic, r.sums) for r in texts.mapInArrow(run, "id long, toxic int, sums array<double>").collect())
    factors, w = fit([np.array(x).reshape(-1, len(CLASSES)) for *_, x in seen], np.array([t for _, t, _ in seen]))
    return Model(model.words, model.stems, factors, bias=float(w[3]), coef=tuple(map(float, w[:3])))


def fit(docs: list[np.ndarray], y: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    """Factors and the logistic function, by coordinate steps: the likelihood of the labels times the prior of the factors."""
    rows = np.concatenate([*docs, np.zeros((0, len(CLASSES)))])
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])

    def fitted(factors: dict[str, float]) -> tuple[float, np.ndarray]:
        scores = rows @ np.array([class_factors(factors)[c] for c in CLASSES])
        most = np.zeros(len(docs))
        np.maximum.at(most, of, scores)
        x = np.log1p(np.c_[np.bincount(of, scores, len(docs)), most, np.bincount(of, scores > 0, len(docs))])
        w = logistic(x, y)
        z = np.clip(x @ w[:3] + w[3], -30, 30)
        loss = np.where(y == 1, np.logaddexp(0, -z), np.logaddexp(0, z)).sum()
        return loss + sum(math.log(factors[k] / PRIOR[k]) ** 2 for k in PRIOR) / (2 * FACTOR_SPREAD**2), w

    best = dict(PRIOR)
    loss, w = fitted(best)
    for _ in range(2):
        for name in PRIOR:
            for step in FACTOR_STEPS:
                tried = best | {name: PRIOR[name] * math.exp(step * FACTOR_SPREAD)}
                other, v = fitted(tried)
                if other < loss - 1e-9:
                    best, loss, w = tried, other, v
    return best, w


def scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score in ``name``: the text column is read by the model, nothing else."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        out = pd.Series([probability(features(t, model), model) for t in texts], dtype=float)
        memory_returned()
        return out

    return docs.withColumn(name, score(F.col("text").cast("string")))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scores(rows, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
