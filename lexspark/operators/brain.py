"""The compiled lexicon: (eng, category) -> form and conjugations, by deterministic merge rules.

Order of a mapping is ``ord`` = (file, stanza_idx, kind of mapping, place): the last form wins, the last
conjugations that aren't empty win, and the first mapping gives a category its place in its entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import held
from ..functions.reference import CATEGORY
from ..functions.text import nfc, trim_blanks
from .stanzas import CONJ, SLOTS, tags


def cleaned_english(c: Column) -> Column:
    bare = trim_blanks(F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", ""))
    return F.lower(F.coalesce(F.regexp_extract(trim_blanks(F.regexp_replace(bare, r"^[tT][oO]\s+", "")), r"^(\S*)", 1), F.lit("")))


def cleaned_reformed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[.,!?()\[\]{}]", ""), r"^\s+|\s+$", "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def composed_text(c: Column) -> Column:
    """Canonical composition; only what isn't ASCII leaves the JVM."""
    return F.when(is_ascii(c), c).otherwise(nfc(F.when(~is_ascii(c), c)))


def composed(conj: Column, ascii: Column) -> Column:
    """Conjugations with every form composed; the English side of explicit pairs is a key and stays as it is.

    ``ascii`` tells whether there is nothing to compose.
    """
    done = F.from_json(nfc(F.when(~ascii, F.to_json(conj))), CONJ)
    pairs = F.transform(F.arrays_zip(conj["explicit"].alias("a"), done["explicit"].alias("b")), lambda z: F.struct(z["a"]["eng"].alias("eng"), z["b"]["ing"].alias("ing")))
    return F.when(ascii | conj.isNull(), conj).otherwise(done.withField("explicit", pairs))


def _forms(conj: Column) -> Column:
    """All forms of conjugations in one text."""
    return F.concat_ws(" ", *[conj[s] for s in SLOTS], conj["plural"], F.array_join(F.transform(conj["explicit"], lambda p: p["ing"]), " "), F.array_join(conj["variants"], " "), F.array_join(conj["forms"], " "))


def judged(records: DataFrame) -> DataFrame:
    """Records with eng and ing, not composed, categories and ``reason`` (null: kept); composition leaves no text empty, so it comes after."""
    table = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    known = F.filter(F.transform(tags(F.lower("pos")), lambda t: F.try_element_at(table, t)), lambda c: c.isNotNull())
    rows = held(records, eng=cleaned_english(F.col("me_word")), categories=known)
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    reason = (
        F.when(blank(F.col("me_word")) | blank(F.col("reformed_word")), "no word")
        .when(F.col("eng") == "", "no English word")
        .when(F.size("categories") == 0, "no known part of speech")
    )
    return held(rows, reason=reason)


def validated(records: DataFrame) -> DataFrame:
    """Records with eng, ing, categories and ``reason`` (null: kept), all forms composed."""
    rows = held(judged(records), ing=cleaned_reformed(F.col("reformed_word")), ascii=is_ascii(_forms(F.col("conjugations"))))
    conj = F.col("conjugations")
    return rows.withColumns({"eng": composed_text(F.col("eng")), "ing": composed_text(F.col("ing")), "conjugations": composed(conj, F.coalesce("ascii", F.lit(True)))}).drop("ascii")


def rejected(records: DataFrame) -> DataFrame:
    return judged(records).where(F.col("reason").isNotNull()).select("file", "stanza_idx", "me_word", "reformed_word", "pos", "reason")


def mappings(records: DataFrame) -> DataFrame:
    """ord, eng, category, form, conj (conj_kind and conjugations) of every kept record: its roots, its explicit pairs, its special case.

    A record is read once: each of its categories gives an array of mappings, told apart by their kind and place.
    """
    kept = validated(records).where(F.col("reason").isNull())
    each = kept.select("file", "stanza_idx", "eng", "ing", "conj_kind", "conjugations", F.posexplode("categories").alias("cat_idx", "category"))
    conj = F.struct("conj_kind", "conjugations")
    none = F.when(F.lit(False), conj)
    mapping = lambda kind, sub, eng, to, form, conj=none: F.struct(F.lit(kind).alias("kind"), sub.cast("int").alias("sub"), eng.alias("eng"), to.alias("category"), form.alias("form"), conj.alias("conj"))
    root = F.array(mapping(0, F.lit(0), F.col("eng"), F.col("category"), F.col("ing"), F.when(F.col("conj_kind") != "empty", conj)))
    pairs = F.transform("conjugations.explicit", lambda p, i: F.struct(p["eng"].alias("eng"), p["ing"].alias("ing"), i.alias("i")))
    pairs = F.filter(pairs, lambda p: (F.coalesce(p["eng"], F.lit("")) != "") & (F.coalesce(p["ing"], F.lit("")) != ""))
    verb = F.transform(pairs, lambda p: mapping(1, p["i"] * 2, F.lower(p["eng"]), F.lit("Verb"), p["ing"]))
    other = F.transform(pairs, lambda p: mapping(1, p["i"] * 2 + 1, F.lower(p["eng"]), F.col("category"), p["ing"]))
    negated = F.coalesce(F.nullif(F.get(F.filter("conjugations.explicit", lambda p: p["eng"] == "can't"), F.lit(0))["ing"], F.lit("")), F.col("ing"))
    can = F.array(mapping(2, F.lit(0), F.lit("cannot"), F.lit("Modal"), negated), mapping(2, F.lit(1), F.lit("cannot"), F.lit("Verb"), negated))
    nothing = F.slice(root, 1, 0)
    some = lambda where, a: F.when(where, a).otherwise(nothing)
    paired = F.col("conjugations.explicit").isNotNull()
    all_of = F.concat(root, some(paired, verb), some(paired & (F.col("category") != "Verb"), other), some((F.col("category") == "Modal") & (F.col("eng") == "can"), can))
    rows = each.select("file", "stanza_idx", "cat_idx", F.explode(all_of).alias("m"))
    return rows.select(F.struct("file", "stanza_idx", "cat_idx", "m.kind", "m.sub").alias("ord"), "m.eng", "m.category", "m.form", "m.conj")


def merged(maps: DataFrame) -> DataFrame:
    """eng, category, form, conj, cat_ord: one row for each lemma and category, in one shuffle."""
    return maps.groupBy("eng", "category").agg(
        F.max_by("form", "ord").alias("form"), F.max_by("conj", F.when(F.col("conj").isNotNull(), F.col("ord"))).alias("conj"), F.min("ord").alias("cat_ord")
    )


def compile_brain(records: DataFrame) -> DataFrame:
    return merged(mappings(records))


def entries(brain: DataFrame) -> DataFrame:
    """One row for each lemma: forms and conjugations by category, and the category that was first."""
    pairs = lambda value: F.map_from_entries(F.collect_list(F.struct("category", value)))
    return brain.groupBy("eng").agg(pairs("form").alias("forms"), pairs("conj").alias("conjs"), F.min_by("category", "cat_ord").alias("first_category"))


def counts(brain: DataFrame, records: DataFrame) -> DataFrame:
    """Records compiled and lemmas made."""
    compiled = judged(records).agg(F.count_if(F.col("reason").isNull()).alias("compiled"))
    return compiled.crossJoin(brain.agg(F.count_distinct("eng").alias("lemmas")))  # one row each


def record_counts(records: DataFrame) -> DataFrame:
    """:func:`counts` of the lexicon compiled from ``records``, in one pass over their lemmas: no form is composed, as that leaves none empty."""
    kept = judged(records).where(F.col("reason").isNull()).withColumn("eng", composed_text(F.col("eng")))
    lemma = lambda eng, n: F.struct(eng.alias("eng"), F.lit(n).cast("long").alias("n"))
    pairs = F.filter("conjugations.explicit", lambda p: (F.coalesce(p["eng"], F.lit("")) != "") & (F.coalesce(p["ing"], F.lit("")) != ""))
    root = F.array(lemma(F.col("eng"), 1))
    paired = F.when(F.col("conjugations.explicit").isNotNull(), F.concat(root, F.transform(pairs, lambda p: lemma(F.lower(p["eng"]), 0)))).otherwise(root)
    can = (F.col("eng") == "can") & F.array_contains("categories", "Modal")
    names = kept.select(F.explode(F.when(can, F.concat(paired, F.array(lemma(F.lit("cannot"), 0)))).otherwise(paired)).alias("l"))
    by_lemma = names.groupBy("l.eng").agg(F.sum("l.n").alias("compiled"))
    return by_lemma.agg(F.coalesce(F.sum("compiled"), F.lit(0)).alias("compiled"), F.count("eng").alias("lemmas"))
