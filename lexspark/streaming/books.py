"""Translation of a stream: books dropped into a folder are transcribed as they come.

Every step is stateless but the audit of missing words, which remembers the words it has told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_clitic
from ..operators.translate import missing_words, reassembled, tagged, transcribe, unmatched


def book_stream(spark: SparkSession, root: str) -> DataFrame:
    """doc_id and text of every file that appears below ``root``, and when it did, however old the file is.

    By itself the source passes over files a week older than the newest it has met.  The price: it remembers all
    files of the folder by name, so a folder of many millions of books should be emptied into others by day.
    """
    rows = spark.readStream.option("maxFileAge", "36500d").text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("at"))


def translate_folder(spark: SparkSession, root: str, brain: DataFrame, out: str, checkpoint: str):
    """Starts the query that writes (doc_id, text) and missing words for each batch; the lexicon is read once.

    Each batch is an ordinary DataFrame, so the batch operators apply as they are.
    """
    def batch(rows: DataFrame, number: int) -> None:
        done = transcribe(tagged(rows), brain).persist()
        reassembled(done).write.mode("overwrite").parquet(f"{out}/texts/batch={number}")
        missing_words(done).write.mode("overwrite").parquet(f"{out}/missing/batch={number}")
        done.unpersist()

    return book_stream(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_missing(spark: SparkSession, root: str, brain: DataFrame, out: str, checkpoint: str, told: DataFrame | None = None):
    """Starts the query that appends each missing word of the books, when it is first met, to ``out``.

    A query with a new checkpoint needs a new ``out`` as well, and what earlier ones wrote as ``told``.
    """
    tokens = tagged(book_stream(spark, root), keep=("at",))
    lacking = unmatched(tokens, brain).where(~F.col("pos").isin("PUNCT", "SPACE", "X") & ~is_clitic(F.lower("text"))).select(F.lower("lemma").alias("word"), "at")
    found = new_missing(lacking, told)
    return found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_missing(words: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Missing words (word, at) of a stream, each once for good, less those of ``told`` (word).

    The words themselves are the state: a row for each distinct one, dealt over the shuffle partitions and never
    forgotten, however long ago it was met.  Texts don't count in it; a vocabulary that outgrows the executors' memory
    wants the session's RocksDB state store.  A null word is told once like others, and again if ``told`` has it.
    """
    if told is not None:
        words = words.join(told.select(F.col("word").alias("_told")).distinct(), F.col("word") == F.col("_told"), "left_anti")
    return words.dropDuplicates(["word"])
