"""Counts, searches and views over parsed records."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from .stanzas import clean_lines, conj_leaves, origin, tags


def pos_frequency(records: DataFrame) -> DataFrame:
    """tag, count of every comma tag, commonest first, ties by tag."""
    return _pos(records.groupBy("pos").count())


def origin_frequency(records: DataFrame) -> DataFrame:
    """lang, count by language of origin; no origin and an empty tag are groups of their own."""
    return _lang(pair_counts(records))


def cross_tabulation(records: DataFrame) -> DataFrame:
    """pos (as it stands), lang ('?' for none), count."""
    return _cells(pair_counts(records))


def pair_counts(records: DataFrame) -> DataFrame:
    """pos, lang of origin (null: none), count: few rows, from which all three statistics follow."""
    return records.groupBy("pos", origin(F.col("etymology"))["lang"].alias("lang")).count()


def _pos(counted: DataFrame) -> DataFrame:
    return counted.select(F.explode(tags(F.col("pos"))).alias("tag"), "count").groupBy("tag").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "tag")


def _lang(counted: DataFrame) -> DataFrame:
    return counted.groupBy("lang").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), F.asc_nulls_first("lang"))


def _cells(counted: DataFrame) -> DataFrame:
    return counted.groupBy("pos", F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "pos", "lang")


def cross_tab_report(records: DataFrame, top: int = 5) -> DataFrame:
    """tag, lang, count of the commonest tags by the commonest languages, 0 where nothing is.

    A record with several tags matches none of them, as its pos is compared whole.
    """
    counted = pair_counts(records).cache()
    pos, lang = _pos(counted).limit(top).select("tag"), _lang(counted).limit(top).select(F.coalesce("lang", F.lit("?")).alias("lang"))
    cells = _cells(counted).select(F.col("pos").alias("tag"), "lang", "count")
    return pos.crossJoin(lang).join(cells, ["tag", "lang"], "left").select("tag", "lang", F.coalesce("count", F.lit(0)).alias("count"))  # top x top rows


def summary(records: DataFrame) -> dict[str, DataFrame]:
    """The three statistics over the counts of one parse, which are cached."""
    counted = pair_counts(records).cache()
    return {"parts_of_speech": _pos(counted), "languages": _lang(counted), "cross_tabulation": _cells(counted)}


def named(frequency: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Counts with full names from a (code, name) table, ``Unknown`` where it has none."""
    return frequency.join(names, F.lower(frequency[key]) == F.lower(names["code"]), "left").select(key, F.coalesce("name", F.lit("Unknown")).alias("name"), "count")


def affixes(words: DataFrame, column: str = "word", n: int = 3, prefix: bool = False, top: int = 20) -> DataFrame:
    """affix, count, percent (of the listed ones) of the commonest affixes of n code points; ties by affix, falling."""
    w = F.col(column)
    affix = F.concat(F.substring(w, 1, n), F.lit("-")) if prefix else F.concat(F.lit("-"), F.right(w, F.lit(n)))
    counted = words.where(F.length(w) >= n).groupBy(affix.alias("affix")).count().orderBy(F.desc("count"), F.desc("affix")).limit(top)
    return counted.withColumn("percent", 100 * F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))))  # of ``top`` rows


def affix_words(records: DataFrame, pos: str | None = None, lang: str | None = None) -> DataFrame:
    """Reformed words of records whose pos contains ``pos`` and whose etymology has ``lang``."""
    rows = records
    if pos:
        rows = rows.where(ascii_lower(F.col("pos")).contains(pos))
    if lang:
        rows = rows.where(F.exists("etymology", lambda e: e["lang"] == lang))
    return rows.select(F.col("reformed_word").alias("word"))


def find_lines(files: DataFrame, query: str) -> DataFrame:
    """file, line of every line that has ``query`` as it is; the filter on whole texts comes first."""
    hits = files.where(F.col("text").contains(query)).select("file", F.explode(F.split("text", "\n")).alias("line"))
    return hits.where(F.col("line").contains(query))


def lookup(records: DataFrame, word: str) -> DataFrame:
    same = lambda c: ascii_lower(F.col(c)) == ascii_lower(F.lit(word))
    return records.where(same("me_word") | same("reformed_word"))


def info(records: DataFrame, word: str) -> DataFrame:
    """Word, pos, language of origin and forms of what :func:`lookup` finds."""
    lang = F.coalesce(F.nullif(origin(F.col("etymology"))["lang"], F.lit("")), F.lit("?"))
    forms = F.array_join(F.filter(conj_leaves(F.col("conj_kind"), F.col("conjugations")), lambda x: x != ""), " ")
    return lookup(records, word).select("reformed_word", "pos", lang.alias("origin"), forms.alias("forms"))


def chain(records: DataFrame, word: str, project: str = "Reformed") -> DataFrame:
    """Etymology of a word, one step a row, ending in the reformed word."""
    steps = F.concat(F.transform("etymology", lambda e: F.concat(F.lit(" ↳ "), e["form"], F.lit("  ["), e["lang"], F.lit("]"))), F.array(F.concat(F.lit(" ↳ "), "reformed_word", F.lit(f"  [{project}]"))))
    return lookup(records, word).select("file", "stanza_idx", F.posexplode(steps).alias("step", "shown"))


def cognates(files: DataFrame, records: DataFrame, query: str) -> DataFrame:
    """Records of files that have ``query`` literally whose forms match it as a pattern, case aside; distinct, sorted."""
    near = files.where(F.col("text").contains(query)).select("file")
    rows = records.join(near, "file", "left_semi")
    hit = F.exists("etymology", lambda e: e["form"].rlike(f"(?i){query}")) | F.col("reformed_word").rlike(f"(?i){query}")
    shown = F.concat(F.col("reformed_word"), F.lit(" ("), F.col("pos"), F.lit(") [from "), F.col("me_word"), F.lit("]"))
    return rows.where(hit).select(shown.alias("shown")).distinct().orderBy("shown")


def resolve_file(files: DataFrame, word: str) -> DataFrame:
    """The file of a word: by its name below the folder of its first letter, else by a whole-word match in it."""
    import re

    inside = files.where(F.col("file").rlike(f"(^|/){re.escape(word[:1])}/[^/]*$"))
    name = F.lower(F.regexp_extract("file", r"([^/]*)\.txt$", 1)) == word.lower()
    whole = F.col("text").rlike(f"(^|[^a-zA-Z]){re.escape(word)}([^a-zA-Z]|$)")
    rows = inside.withColumn("tier", F.when(name, 1).when(whole, 2)).where(F.col("tier").isNotNull())
    return rows.orderBy("tier", "file").limit(1).select("file")


def verb_coverage(records: DataFrame) -> DataFrame:
    """kind (standard or nonstandard), file, word, forms of verbs with that tag alone."""
    c = F.col("conjugations")
    regular = (c["third_singular"] == "-s") & c["past"].isin("-d", "-ed") & (c["gerund"] == "-ing")
    slots = F.when(F.coalesce(c["present"], F.lit("")) != "", F.array(c["present"], c["third_singular"], c["past"], c["participle"], c["gerund"])).otherwise(F.array(c["third_singular"], c["past"], c["gerund"]))
    forms = F.array_join(F.filter(slots, lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    return records.where(ascii_lower(F.col("pos")).isin("v", "tr v", "intr v")).select(F.when(F.coalesce(regular, F.lit(False)), "standard").otherwise("nonstandard").alias("kind"), "file", F.col("reformed_word").alias("word"), forms.alias("forms"))


def search(docs: DataFrame, query: str, top: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: how often a document has the query's words; ties by id.  A blank query finds nothing."""
    words = sorted({w for w in query.lower().split() if w})
    if not words:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    import re

    pattern = "(?<![a-z])(?:" + "|".join(map(re.escape, words)) + ")(?![a-z])"
    score = F.regexp_count(F.lower(text_col), F.lit(pattern)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(top)


def term_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, section (lines from 1), n: how often a section has a term.  Written once, partitioned or sorted by term, it serves any number of searches."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.lower(text_col), "\n")).alias("p", "line"))
    terms = lines.select("doc_id", (F.col("p") + 1).alias("section"), F.explode(F.regexp_extract_all("line", F.lit("[a-z]+"), F.lit(0))).alias("term"))
    return terms.groupBy("term", "doc_id", "section").agg(F.count("*").alias("n"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """:func:`term_index` as a table in ``path``, a folder for each bucket of terms, sorted by term in every file.

    The postings of a frequent term are split over tasks and files; searches then read the buckets of their words only.
    """
    dealt = index.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "term", "doc_id", "section").write.partitionBy("bucket").parquet(path)


def stored_index(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """The part of a written index that a query needs: its words' folders, and of these the row groups that hold them."""
    words = sorted({w for w in query.lower().split() if w})
    index = spark.read.schema("term string, doc_id long, section int, n long, bucket int").parquet(path)
    folders = functools.reduce(lambda a, w: a | (F.col("bucket") == bucket_of(F.lit(w), buckets)), words, F.lit(False))
    return index.where(folders).drop("bucket")


def search_index(index: DataFrame, query: str, top: int = 15, sections: int = 3) -> DataFrame:
    """doc_id, score, sections, section, section_score: the best documents, and of each its best sections (ties by place).  A blank query finds nothing."""
    words = sorted({w for w in query.lower().split() if w})
    hits = index.where(F.col("term").isin(*words) if words else F.lit(False)).groupBy("doc_id", "section").agg(F.sum("n").alias("section_score"))
    best = hits.groupBy("doc_id").agg(F.sum("section_score").alias("score"), F.count("*").alias("sections")).orderBy(F.desc("score"), "doc_id").limit(top)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("section_score"), "section"))
    return hits.join(best, "doc_id").withColumn("rank", rank).where(F.col("rank") <= sections).select("doc_id", "score", "sections", "section", "section_score")


def flattened(records: DataFrame) -> DataFrame:
    """me_word, reformed_word, pos, conjugations (its strings joined): the columns of the CSV export."""
    return records.select("me_word", "reformed_word", "pos", F.array_join(conj_leaves(F.col("conj_kind"), F.col("conjugations")), " ").alias("conjugations"))


def csv_lines(records: DataFrame) -> DataFrame:
    """Lines of the CSV export without the header, every field quoted."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return flattened(records).select(F.concat_ws(",", *[quoted(c) for c in ("me_word", "reformed_word", "pos", "conjugations")]).alias("line"))


def json_lines(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct("me_word", "reformed_word", "pos", "conjugations", "etymology", "sources")).alias("line"))


def lines_of(files: DataFrame) -> DataFrame:
    return files.select("file", F.explode(clean_lines(F.col("text"))).alias("line"))


