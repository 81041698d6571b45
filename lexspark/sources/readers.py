"""Readers: every source as a DataFrame, listed and read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = "array<struct<text:string,lemma:string,pos:string,tag:string,is_ent:boolean,whitespace:string>>"
RECORD = "me_word string, reformed_word string, pos string, conjugations string, etymology array<struct<form:string,lang:string>>, sources array<string>"


def relative(root: str):
    """The path of a file below ``root``."""
    path = F.expr("replace(_metadata.file_path, '%20', ' ')")
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "^" + root.rstrip("/") + "/", "")


def text_files(spark: SparkSession, root: str, pattern: str | None = "*.txt") -> DataFrame:
    """file (below ``root``) and text of every file, whole; ``pattern`` None reads those without an extension too."""
    options = {"recursiveFileLookup": True, "wholetext": True} | ({"pathGlobFilter": pattern} if pattern else {})
    return spark.read.text(root, **options).select(relative(root).alias("file"), F.col("value").alias("text"))


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """The same for one file; an absent file raises."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def tokens_of(files: DataFrame) -> DataFrame:
    """Token rows of (file, text), each text a JSON array of tokens, with doc_id (the file) and tok_idx."""
    rows = files.select(F.col("file").alias("doc_id"), F.posexplode(F.from_json("text", TOKENS)).alias("tok_idx", "t"))
    return rows.select("doc_id", "tok_idx", "t.*")


def token_files(spark: SparkSession, root: str) -> DataFrame:
    """Token rows of JSON files; a file that is no array of tokens gives none, :func:`broken_token_files` names it."""
    return tokens_of(text_files(spark, root, "*.json"))


def broken_token_files(files: DataFrame) -> DataFrame:
    """file of those (file, text) whose text is no JSON array of tokens: null, empty, or malformed."""
    return files.where(F.from_json("text", TOKENS).isNull()).select("file")


def record_lines(spark: SparkSession, path: str, word_field: str = "reformed_word") -> DataFrame:
    """Records of a JSON-lines dataset; ``conjugations`` comes as JSON text, a legacy array counts as corrupt and is dropped.

    ``word_field`` is the name that the dataset has for the reformed word.
    """
    rows = spark.read.schema(RECORD.replace("reformed_word", word_field)).json(path).withColumnRenamed(word_field, "reformed_word")
    return rows.where(F.col("conjugations").isNull() | ~F.col("conjugations").startswith("["))


def code_table(spark: SparkSession, path: str) -> DataFrame:
    """code, name of a two-column TSV."""
    return spark.read.csv(path, sep="\t", schema="code string, name string").where(F.col("code").isNotNull())


def glyph_files(spark: SparkSession, root: str) -> DataFrame:
    """name, category, paths of a folder of glyph files."""
    return spark.read.json(root, schema="name string, category string, paths array<string>", multiLine=True, pathGlobFilter="*.json")


def literal(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """code, name rows of a small fixed table."""
    return spark.createDataFrame(sorted(mapping.items()), "code string, name string")


def reference_glyphs(spark: SparkSession, collections: dict[str, list[dict]]) -> DataFrame:
    """collection, name, category, paths of literal glyph sets."""
    rows = [(c, g["name"], g.get("category"), g["paths"]) for c, glyphs in collections.items() for g in glyphs]
    return spark.createDataFrame(rows, "collection string, name string, category string, paths array<string>")


def glyphs_in(glyphs: DataFrame, tab: str) -> DataFrame:
    """Glyphs of a category; those without one are ``Custom``."""
    return glyphs.where(F.coalesce(F.nullif("category", F.lit("")), F.lit("Custom")) == tab)
