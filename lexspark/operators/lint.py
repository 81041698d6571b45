"""Data-quality rules over entry files: one row for each issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import held
from .stanzas import clean_lines, etymology_of, is_reformed, is_url, origin, paragraphs, stanzas, tags

FATAL, ERROR, WARN = "FATAL", "ERROR", "WARN"


LEVELS = {"L1": FATAL, "L2": ERROR, "L3": ERROR, "L4": ERROR, "L5": WARN, "L6": ERROR, "L7": WARN, "L8": WARN}
POS_AT_END = r"\(([a-z][a-z ,]*)\)[ \t]*$"


def _hit(rule: str, where: Column, place: Column | None = None, word: Column | None = None) -> Column:
    """An array of what breaks a rule: empty, or one struct."""
    found = F.struct(F.lit(rule).alias("rule"), (F.lit(0) if place is None else place).cast("int").alias("place"), (F.lit("") if word is None else word).alias("word"))
    return F.when(where, F.array(found)).otherwise(F.array().cast("array<struct<rule:string,place:int,word:string>>"))


def file_hits(text: Column, lines: Column) -> Column:
    """What breaks the rules for whole files: L1 to L5."""
    some = F.coalesce(F.length(text), F.lit(0)) > 0
    plain = lambda pattern: F.exists(lines, lambda x: ~x.contains("http") & x.rlike(pattern))
    return F.concat(
        _hit("L1", ~some), _hit("L2", some & ~plain(r"\([a-z ]{1,5}(, [a-z ]{1,5})*\)")), _hit("L3", some & ~plain(r"\[[A-Z]+\]")),
        _hit("L4", some & plain(r"\[[A-Z]+\].*\(|\(.*\[[A-Z]+\]")), _hit("L5", some & F.exists(lines, lambda x: x.rlike(r"[ \t\r\f\x0B]$"))),
    )


def stanza_hits(place: Column, lines: Column, reformed: Column) -> Column:
    """What breaks the rules for stanzas, L6 and L8, and every part-of-speech tag, for L7."""
    shaped = lambda x: ~is_url(x) & ~x.rlike(r"\[[A-Z]+\]") & ~x.rlike(r"\([a-z]") & x.rlike(r"(^| )-[a-z]+|\(s( |$)")
    lang = origin(etymology_of(lines))["lang"]
    found = F.flatten(F.transform(F.filter(lines, lambda x: ~is_url(x) & ~x.rlike(r"\[[A-Z]")), lambda x: tags(F.regexp_extract(x, POS_AT_END, 1))))
    named = F.transform(F.array_distinct(found), lambda t: F.struct(F.lit("L7").alias("rule"), F.lit(0).alias("place"), t.alias("word")))
    return F.concat(_hit("L6", ~reformed & F.exists(lines, shaped), place), named, _hit("L8", reformed & (F.coalesce(lang, F.lit("")) == "")))


def issues(files: DataFrame, pos_codes: DataFrame) -> DataFrame:
    """file, rule, level, detail.  ``files``: file, text; ``pos_codes``: code.

    A file is read once: its text, as place 0, and its stanzas give an array of hits each, which are told apart after
    one explode.
    """
    parts = F.concat(F.array(F.struct(F.lit(0).alias("place"), F.col("text").alias("part"))), F.transform(paragraphs(F.coalesce("text", F.lit(""))), lambda s, i: F.struct((i + 1).alias("place"), s.alias("part"))))
    rows = files.select("file", F.explode(parts).alias("p")).select("file", "p.place", "p.part")
    whole = F.col("place") == 0
    rows = held(rows, lines=F.when(whole, F.split("part", "\n")).otherwise(clean_lines(F.col("part"))))
    rows = held(rows, reformed=~whole & F.exists("lines", is_reformed))
    hits = F.when(whole, file_hits(F.col("part"), F.col("lines"))).otherwise(stanza_hits(F.col("place"), F.col("lines"), F.col("reformed")))
    found = rows.select("file", F.explode(hits).alias("h")).select("file", "h.*")
    known = pos_codes.select(F.lower("code").alias("code")).distinct()
    found = found.join(known, (F.col("rule") == "L7") & (F.lower("word") == F.col("code")), "left_anti")
    places = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("rule") == "L6", F.col("place")))), lambda n: n.cast("string")), " ")
    words = F.array_join(F.array_sort(F.collect_set(F.when(F.col("rule") == "L7", F.col("word")))), " ")
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return found.groupBy("file", "rule").agg(places.alias("places"), words.alias("words")).select("file", "rule", level[F.col("rule")].alias("level"), F.concat("places", "words").alias("detail"))


def unknown_tags(files: DataFrame, pos_codes: DataFrame) -> DataFrame:
    """file, tag: part-of-speech tags that the table doesn't have."""
    lines = F.filter(clean_lines(F.col("stanza")), lambda x: ~is_url(x) & ~x.rlike(r"\[[A-Z]"))
    tag = stanzas(files).select("file", F.explode(lines).alias("x")).select("file", F.explode(tags(F.regexp_extract("x", POS_AT_END, 1))).alias("tag")).distinct()
    return tag.join(pos_codes.select(F.lower("code").alias("code")), F.lower("tag") == F.col("code"), "left_anti")


def totals(files: DataFrame, found: DataFrame) -> DataFrame:
    """files, fatals, errors, warns and ``failed``: whether there is a fatal or an error."""
    n = found.agg(*[F.count_if(F.col("level") == x).alias(name) for x, name in ((FATAL, "fatals"), (ERROR, "errors"), (WARN, "warns"))])
    return files.agg(F.count("*").alias("files")).crossJoin(n).withColumn("failed", F.col("fatals") + F.col("errors") > 0)  # one row each
