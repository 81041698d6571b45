"""A corpus pipeline of five stages, each calling one operator of ``lexspark.llm``.

Toxic documents go, then those in no learned language; one document of each class of near copies stays; personal
data gets pseudonyms; what is left is packed into training sequences.  Each stage reads what its predecessor
wrote.  Rows that come with nulls, empty texts or repeats are treated as the operators say; a stage returns the
columns of ``documents``, in their order, and drops others never.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import langid, packing, pseudonyms, simhash, toxicity
from lexspark.llm.queries import TOKENIZER, _public
from lexspark.llm.work import free, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of the labels and of the documents they name."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free(docs, "__score")
    return toxicity.scores(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of some language; text without a letter is in none."""
    found = free(docs, "__found")
    return langid.predictions(docs, langid.train(docs), found).where(~F.col(found)["rejected"]).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of runs of five words at a similarity of 0.8 or more."""
    return simhash.deduplicated(docs)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` counts the new text."""
    found = free(docs, "__found")
    done = pseudonyms.pseudonymised(docs, found_col=found)
    changed = F.when(F.col(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, *_public(TOKENIZER))


STAGES = [
    ("toxicity", without_toxic),
    ("language", in_known_language),
    ("near_copies", one_of_near_copies),
    ("pseudonyms", with_pseudonyms),
    ("packing", packed),
]

#: SQL can't express learned models, encoders or bins; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
