"""History files: each stanza without its reformed line, under the name of its English word and part of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reference import HISTORY_POS
from ..functions.text import trim_blanks, without_to
from .stanzas import is_url, stanzas


def split_histories(files: DataFrame, dirs: list[str] | None = None) -> DataFrame:
    """dir, name, text: the last stanza of (file, stanza_idx) wins a name.

    The reformed line is the last one that ends in parentheses before the first URL; the line above it names the
    word.  ``files`` has file and text; the directory is the last folder of file, and ``dirs`` restricts to some.
    """
    rows = stanzas(files).withColumn("dir", F.regexp_extract("file", r"([^/]*)/[^/]*$", 1))
    if dirs is not None:
        rows = rows.where(F.col("dir").isin(*dirs))
    rows = rows.withColumn("lines", F.transform(F.split("stanza", "\n"), lambda x: F.replace(x, F.lit("\r"), F.lit(""))))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    first_url = F.coalesce(F.get(F.filter(numbered, lambda r: is_url(r["x"])), F.lit(0))["i"], F.size("lines"))
    rows = rows.withColumn("at", first_url)
    found = F.filter(numbered, lambda r: (r["i"] < F.col("at")) & r["x"].rlike(r"\([^)]+\)[ \t]*$") & ~r["x"].rlike(r"\[[A-Z]"))
    rows = rows.withColumn("r", F.try_element_at(found, F.lit(-1))).where(F.col("r.i") > 0)
    inside = F.regexp_replace(F.regexp_replace("r.x", r"^.*\(", ""), r"\).*$", "")
    tag = F.lower(trim_blanks(F.get(F.split(inside, ","), F.lit(0))))
    named = None
    for name, endings in HISTORY_POS.items():
        hit = tag.rlike(rf"(?:^|[ \t])(?:{endings})$")
        named = F.when(hit, F.lit(name)) if named is None else named.when(hit, F.lit(name))
    base = F.regexp_replace(F.get("lines", F.col("r.i") - 1), r"\[[A-Za-z0-9_ -]+\]", "")
    word = F.coalesce(F.get(F.split(without_to(trim_blanks(base)), r"[ \t,]+"), F.lit(0)), F.lit(""))
    rows = rows.select(
        "dir", "file", "stanza_idx", word.alias("word"), named.otherwise(F.regexp_replace(tag, "[^a-z0-9]", "_")).alias("pos"),
        F.array_join(F.filter("lines", lambda x, i: i != F.col("r.i")), "\n").alias("text"),
    ).where((F.col("word") != "") & (F.col("pos") != ""))
    rows = rows.withColumn("name", F.concat("word", F.lit("_"), "pos", F.lit(".txt")))  # by which they meet: two words can share one
    last = F.row_number().over(Window.partitionBy("dir", "name").orderBy(F.col("file").desc(), F.col("stanza_idx").desc()))
    return rows.withColumn("rn", last).where("rn = 1").select("dir", "word", "pos", "name", "text")
