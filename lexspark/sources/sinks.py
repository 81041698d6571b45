"""Sinks: what the toolkit writes, through Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glyph_slug
from ..operators import graph
from ..operators.analytics import flattened, json_lines
from .tree import write_tree


def write_json_lines(records: DataFrame, path: str) -> int:
    """Records as JSON lines; returns how many."""
    json_lines(records).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    return records.sparkSession.read.text(path).count()


def write_csv(records: DataFrame, path: str, count_header: bool = True) -> int:
    """The flat export with a header, every field quoted; the count reported has always included the header."""
    flattened(records).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
    return records.count() + int(count_header)


def write_brain(brain: DataFrame, path: str, as_json: bool = False) -> None:
    """The compiled lexicon in rows, or one JSON object a lemma in the order of lemmas."""
    if not as_json:
        brain.write.mode("overwrite").parquet(path)
        return
    brain_json_lines(brain).orderBy("eng").select("value").write.mode("overwrite").text(path)


def member(key: Column, json: Column) -> Column:
    """``"key":json`` of an object; the key is quoted as JSON is."""
    one = F.to_json(F.create_map(key, F.lit("")))  # {"key":""}
    return F.concat(F.substr(one, F.lit(2), F.length(one) - 4), json)


def quoted(text: Column) -> Column:
    """A string as JSON."""
    one = F.to_json(F.array(text))
    return F.substr(one, F.lit(2), F.length(one) - 2)


def brain_json_lines(brain: DataFrame) -> DataFrame:
    """eng and value: one object a lemma, its categories in the order they came, each followed by its conjugations."""
    rows = brain.select("eng", "cat_ord", member(F.col("category"), quoted(F.col("form"))).alias("form"), member(F.concat("category", F.lit("_conjugations")), F.to_json("conj.conjugations")).alias("conj"))
    held = F.array_sort(F.collect_list(F.struct("cat_ord", F.concat_ws(",", "form", "conj").alias("members"))))
    entry = F.concat(F.lit("{"), F.array_join(F.transform(held, lambda x: x["members"]), ","), F.lit("}"))
    return rows.groupBy("eng").agg(entry.alias("entry")).select("eng", F.concat(F.lit("{"), member(F.col("eng"), F.col("entry")), F.lit("}")).alias("value"))


def write_books(texts: DataFrame, path: str) -> None:
    """One folder for each document: ``doc_id`` partitions the text files."""
    texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def _folder(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_words(words: DataFrame, path: str) -> bool:
    """A sorted word list; without words nothing is left there."""
    spark = words.sparkSession
    words.select(F.col(words.columns[0]).alias("value")).orderBy("value").write.mode("overwrite").text(path)
    some = not spark.read.text(path).isEmpty()
    if not some:
        p, files = _folder(spark, path)
        files.delete(p, True)
    return some


def write_histories(histories: DataFrame, path: str, dry_run: bool = False) -> list[str]:
    """Each history as ``<dir>/<word>_<pos>.txt`` below ``path``, by the executors; returns the names, for a reader to be told.

    Names alone reach the driver, and of a dry run nothing else is made; :func:`history_files` without them is for
    dictionaries of any size.
    """
    named = history_files(histories)
    if not dry_run:
        write_tree(named, path)
    return sorted(r.file for r in named.select("file").toLocalIterator())


def history_files(histories: DataFrame) -> DataFrame:
    """file and text of each history, as ``tree.write_tree`` takes them; a text ends in a line end."""
    return histories.select(F.concat_ws("/", "dir", "name").alias("file"), F.concat("text", F.lit("\n")).alias("text"))


def write_graph(records: DataFrame, path: str) -> None:
    """The etymology graph as JSON lines, ``nodes`` and ``edges``; one document of a few records is ``graph.document``."""
    for name, rows in (("nodes", graph.nodes(records)), ("edges", graph.edges(records))):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def checked_glyphs(glyphs: DataFrame) -> DataFrame:
    """What a save is given: slug, record as JSON, and status 400 without a name or paths, else 200."""
    bad = (F.coalesce("name", F.lit("")) == "") | F.col("paths").isNull()
    record = F.to_json(F.struct("name", F.coalesce(F.nullif("category", F.lit("")), F.lit("Custom")).alias("category"), "paths"))
    return glyphs.select("name", F.when(bad, 400).otherwise(200).alias("status"), F.when(~bad, glyph_slug(F.col("name"))).alias("slug"), F.when(~bad, record).alias("record"))


def write_glyphs(glyphs: DataFrame, path: str) -> None:
    checked_glyphs(glyphs).where("status = 200").select("slug", F.col("record").alias("value")).write.mode("overwrite").partitionBy("slug").text(path)
