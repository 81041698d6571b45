"""Token counts of whole texts without their ids: pieces of each distinct pre-token are counted once, and joined to how
often each document has it.

A pre-token is a run of spaces and the run of other characters after it, a run of line feeds, or spaces alone.  No piece
of the vocabulary has a space after another character or holds a line feed (checked when the model is read), so no merge
crosses the places where texts are cut, and a text's count is the sum over its pre-tokens.

Blocks of documents are tokenised together: a row for each pre-token of a block lists the documents that have it and
how often.  These rows meet by pre-token, in sorted order, so that the model counts each pre-token once and its count
is joined to all its lists as they stream by; what moves is lists, not texts.  A word that all documents share has a
row for each block, so blocks are gathered in groups of bounded size, and a pre-token is counted once in each group:
once in all up to some gigabytes of text, and never so that its rows meet in one task beyond that.

Cases: a null text is empty, with no token; repeated rows and null doc_ids have rows of their own; a pre-token of any
length is taken whole; the space's own sign (U+2581) counts as a space, as the library takes it; a document that holds
a pre-token over 255 times is listed several times; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import memory_returned

SIGN = "▁"
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n+")
#: Characters and documents of a block, at most, but for one document that is longer; partitions whose blocks are a group.
BLOCK_CHARS, BLOCK_DOCS, GROUP = 30_000_000, 60_000, 64
MOST = 255
#: Documents whose sums a task holds before it gives them out.
HELD = 2_000_000


@functools.cache
def model(path: str):
    """The library's model; its vocabulary must allow the cuts."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (held.id_to_piece(i) for i in range(held.get_piece_size()))
    if any("\n" in p or SIGN in p.lstrip(SIGN) for p in pieces):
        raise ValueError("a piece of this vocabulary spans pre-tokens")
    if len(held.encode("\n")) != 2 or held.encode(f"a{SIGN}b") != held.encode("a b"):
        raise ValueError("this model doesn't take spaces as they are")
    return held


def pieces_of(path: str, pre_tokens: list[str]) -> np.ndarray:
    """How many pieces the model makes of each pre-token inside a text."""
    # a line feed before it takes up the space that the model puts before a text
    return np.array([len(ids) - 2 for ids in model(path).encode(["\n" + p for p in pre_tokens], num_threads=1)], np.int64)


def pre_tokens(text: str) -> Counter:
    """How often each pre-token is in a text, with the space that the model puts before it."""
    return Counter(PRE_TOKEN.findall(" " + text.replace(SIGN, " "))) if text else Counter()


#: hits: a 16-bit number of each document and then 8 bits of how often; of a head: ids, sizes and whether the id is null.
LISTED = "block long, token string, hits binary, part int"
HITS = pa.schema([("block", pa.int64()), ("token", pa.string()), ("hits", pa.binary()), ("part", pa.int32())])


def _block(number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
    """A row for each pre-token of the documents, and a head that tells what the documents are, under a name that is no pre-token."""
    places: dict[str, int] = {}
    token, doc, times = [], [], []
    for at, text in enumerate(texts):
        found = pre_tokens(text)
        token.append(np.fromiter((places.setdefault(t, len(places)) for t in found), np.int64, len(found)))
        times.append(np.fromiter(found.values(), np.int64, len(found)))
        doc.append(np.full(len(found), at, np.int64))
    token, doc, times = np.concatenate(token), np.concatenate(doc), np.concatenate(times)
    while len(times) and times.max() > MOST:
        over = times > MOST
        token, doc, times = np.r_[token, token[over]], np.r_[doc, doc[over]], np.r_[np.where(over, MOST, times), times[over] - MOST]
    order = np.argsort(token, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(token, minlength=len(places)))]
    doc, times = doc[order].astype("<u2").tobytes(), times[order].astype("u1").tobytes()
    hits = [doc[2 * a : 2 * b] + times[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    sizes = np.array([len(t.encode()) for t in texts], "<i8")
    null = np.array([i is None for i in ids], "u1")
    head = np.array([i or 0 for i in ids], "<i8").tobytes() + sizes.tobytes() + null.tobytes()
    n = len(places) + 1
    columns = [pa.array(np.full(n, number)), pa.array([*places, f"\n{number}"]), pa.array([*hits, head], pa.binary()), pa.array(np.full(n, (number >> 32) // GROUP, np.int32))]
    return pa.RecordBatch.from_arrays(columns, schema=HITS)


def _sliced(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def listed(docs: DataFrame) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text); a block's number is its partition's and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, chars = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if texts and (chars + len(text) > BLOCK_CHARS or len(texts) == BLOCK_DOCS):
                    yield from _sliced(_block(number, ids, texts))
                    number, ids, texts, chars = number + 1, [], [], 0
                ids.append(doc_id.as_py())
                texts.append(text)
                chars += len(text)
        if texts:
            yield from _sliced(_block(number, ids, texts))
        memory_returned()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LISTED)


def summed(rows: DataFrame, path: str) -> DataFrame:
    """block, head, sums: what each task's rows of :func:`listed`, sorted by token, add to the documents of a block.

    A row for each block and task (16-bit numbers of documents, then their 64-bit sums), and the heads as they come.
    """
    schema = pa.schema([("block", pa.int64()), ("head", pa.binary()), ("sums", pa.binary())])

    def row(number, head, sums):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([head], pa.binary()), pa.array([sums], pa.binary())], schema=schema)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        last, pieces = None, 0

        def given():
            for number, found in sums.items():
                some = np.flatnonzero(found)
                yield row(number, None, some.astype("<u2").tobytes() + found[some].astype("<i8").tobytes())
            sums.clear()

        for batch in batches:
            tokens = batch["token"].to_pylist()
            is_head = lambda t: t[0] == "\n" and t != "\n" * len(t)
            new = [t for t in dict.fromkeys(tokens) if t != last and not is_head(t)]
            counts = dict(zip(new, pieces_of(path, new).tolist())) | ({last: pieces} if last is not None else {})
            for number, token, hits in zip(batch["block"].to_pylist(), tokens, batch["hits"].to_pylist()):
                if is_head(token):
                    yield row(number, hits, None)
                    continue
                n = len(hits) // 3
                docs, times = np.frombuffer(hits, "<u2", n), np.frombuffer(hits, "u1", n, 2 * n)
                held = sums.get(number)
                top = int(docs[-1]) + 1 if n == 1 else int(docs.max()) + 1
                if held is None or len(held) < top:
                    sums[number] = held = np.r_[held if held is not None else np.zeros(0, np.int64), np.zeros(max(top - (0 if held is None else len(held)), 256), np.int64)]
                if n == 1:
                    held[docs[0]] += counts[token] * int(times[0])
                elif len(np.unique(docs)) == n:
                    held[docs] += counts[token] * times.astype(np.int64)
                else:  # listed several times
                    np.add.at(held, docs, counts[token] * times.astype(np.int64))
            if new:
                last, pieces = new[-1], counts[new[-1]]
            if sum(map(len, sums.values())) > HELD:
                yield from given()
        yield from given()
        memory_returned()

    return rows.mapInArrow(run, "block long, head binary, sums binary")


def of_documents(parts: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document: the parts of a block come together in order, its head first, and are added up."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        head, total = None, None

        def done():
            n = len(total)
            ids = pa.array(np.frombuffer(head, "<i8", n), mask=np.frombuffer(head, "u1", n, 16 * n) > 0)
            return pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(head, "<i8", n, 8 * n)), pa.array(total)], schema=schema)

        for batch in batches:
            for new, sums in zip(batch["head"].to_pylist(), batch["sums"].to_pylist()):
                if new is not None:
                    if head is not None:
                        yield done()
                    head, total = new, np.zeros(len(new) // 17, np.int64)
                else:
                    n = len(sums) // 10
                    total[np.frombuffer(sums, "<u2", n)] += np.frombuffer(sums, "<i8", n, 2 * n)
        if head is not None:
            yield done()
        memory_returned()

    return parts.repartition("block").sortWithinPartitions("block", F.col("head").isNull()).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def counted(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit``) of every row of ``docs``, a table as it is read."""
    rows = listed(docs).repartition("token", "part").sortWithinPartitions("token").select("block", "token", "hits")
    return of_documents(summed(rows, path)).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
