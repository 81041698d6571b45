"""Operator 11 against the library on whole texts."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import sentencepiece

from lexspark.llm import tokencounts
from lexspark.llm.queries import PIECES, op11_token_counts
from lexspark.llm.work import table

PATH = public_tokenizers.path(PIECES)
SCHEMA = "doc_id long, text string, block string, pieces string"


def library(rows):
    held = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t or "" for _, t in rows]
    return Counter((d, len(t.encode()), len(ids), len(ids) > 4096) for (d, _), t, ids in zip(rows, texts, held.encode(texts)))


def ours(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert ours(op11_token_counts(spark, sf)) == library(rows)


def test_odd_texts(spark):
    draw = random.Random(3)
    letters = list("aab the  \n\t.,▁é你🙂\x00\r\x0b ｆ") + ["<s>", "</s>", "<unk>", "<0x0A>", "<pad>", " ", "ing", "   "]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(300)]
    texts += [None, "", " ", "\n", "▁", "a" * 70_000, "ab " * 70_001, "x\n" * 66_000, "\n" * 70_000, " " * 999, "same", "same"]
    rows = [(None if i % 50 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(5, "twice")] * 3
    frame = spark.createDataFrame([(*r, "b", "p") for r in rows], SCHEMA)
    assert ours(tokencounts.counted(frame, PATH)) == library(rows)
    assert tokencounts.counted(frame.limit(0), PATH).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "BLOCK_DOCS", 3)
    rows = [(i, f"the {i} the word " * (i % 4)) for i in range(20)]
    batches = tokencounts.listed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert batches.count() > 20
    monkeypatch.setattr(tokencounts, "HELD", 1)
    assert ours(tokencounts.counted(spark.createDataFrame(rows, "doc_id long, text string"), PATH)) == library(rows)
    assert tokencounts.pieces_of(PATH, [" the", "  the", "\n\n", "x", " "]).tolist() == [1, 2, 2, 1, 1]
