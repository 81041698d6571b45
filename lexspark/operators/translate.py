"""Token streams into reformed text: lookup, routing, morphology, casing, reassembly, audits.

``tokens`` has doc_id, tok_idx, text, lemma, pos, tag, is_ent, whitespace; order is by tok_idx alone.  The
lexicon is joined twice, on the text and on the lemma; it is broadcast only if Spark's own size estimate lies
under the session's threshold, so a large lexicon is joined by shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import let
from ..functions.text import is_clitic, match_casing, resolve_form
from .brain import entries

#: Coarse tags and the categories tried for them, in order.
ROUTES = {
    "VERB": ["Verb"], "AUX": ["Verb", "Copula", "Auxiliary", "Modal"], "NOUN": ["Noun"], "PROPN": ["Noun"], "ADJ": ["Adjective"], "ADV": ["Adverb"],
    "PRON": ["Pronoun"], "DET": ["Determiner"], "ADP": ["Preposition", "Conjunction"], "SCONJ": ["Preposition", "Conjunction"], "CCONJ": ["Preposition", "Conjunction"],
}


def routed(pos: Column, forms: Column, first: Column) -> Column:
    """struct(category, is_fallback): the first category of the route that the entry has, else its first, flagged."""
    has = lambda c: F.coalesce(F.try_element_at(forms, F.lit(c)), F.lit("")) != ""
    choice = None
    for tag, categories in ROUTES.items():
        for c in categories:
            hit = (pos == tag) & has(c)
            choice = F.when(hit, F.lit(c)) if choice is None else choice.when(hit, F.lit(c))
    direct = choice.otherwise(F.lit(None).cast("string"))
    return F.struct(F.coalesce(direct, first).alias("category"), direct.isNull().alias("is_fallback"))


def inflected(tag: Column, word: Column, conj: Column) -> Column:
    """The form for a Penn tag; an empty slot counts as absent."""
    slot = lambda name: F.nullif(conj[name], F.lit(""))
    suffixed = (
        F.when(tag == "NNS", F.coalesce(slot("plural"), F.lit("-s")))
        .when(tag == "VBZ", F.coalesce(slot("third_singular"), F.lit("-s")))
        .when(tag == "VBD", F.coalesce(slot("past"), F.lit("-d")))
        .when(tag == "VBN", F.coalesce(slot("participle"), slot("past"), F.lit("-d")))
        .when(tag == "VBG", F.coalesce(slot("gerund"), F.lit("-ing")))
    )
    # one call for the slot that is chosen, each value named once: the code of a plan has a limit of 64 KB
    resolved = let(F.struct(suffixed.alias("form"), word.alias("word")), lambda v: resolve_form(v["form"], v["word"], tag == "VBG"))
    return F.when(tag == "VBP", F.coalesce(slot("present"), word)).when(tag.isin("NNS", "VBZ", "VBD", "VBN", "VBG"), resolved).otherwise(word)


def transcribed_words(words: DataFrame, brain: DataFrame) -> DataFrame:
    """Distinct (text, lemma, pos, tag, is_ent) with word, missing (lemma or null) and fallback (line or null)."""
    entry = entries(brain)
    raw, low = F.lower("text"), F.lower("lemma")
    rows = words.withColumn("raw", raw).withColumn("low", low)
    rows = rows.withColumn("bypass", F.col("pos").isin("SPACE", "PUNCT", "X") | F.col("is_ent") | is_clitic(F.col("raw")))
    by_text, by_lemma = entry.select(F.col("eng").alias("raw"), F.struct("forms", "conjs", "first_category").alias("a")), entry.select(F.col("eng").alias("low"), F.struct("forms", "conjs", "first_category").alias("b"))
    rows = rows.join(by_text, "raw", "left").join(by_lemma, "low", "left").withColumn("e", F.coalesce("a", "b"))
    rows = rows.withColumn("route", routed(F.col("pos"), F.col("e.forms"), F.col("e.first_category")))
    base = F.nullif(F.try_element_at("e.forms", F.col("route.category")), F.lit(""))
    rows = rows.withColumn("base", base).withColumn("conj", F.try_element_at("e.conjs", F.col("route.category"))["conjugations"])
    whole = F.col("a").isNotNull() & (F.col("raw") != F.col("low"))
    word = let(F.when(whole, F.col("base")).otherwise(inflected(F.col("tag"), F.col("base"), F.col("conj"))), lambda w: match_casing(F.col("text"), w))
    missing = ~F.col("bypass") & F.col("base").isNull()
    return rows.select(
        "text", "lemma", "pos", "tag", "is_ent", F.when(F.col("bypass"), F.col("text")).when(missing, F.concat(F.lit("["), F.col("text"), F.lit("]"))).otherwise(word).alias("word"),
        F.when(missing, F.col("low")).alias("missing"),
        F.when(~F.col("bypass") & ~missing & F.col("route.is_fallback"), F.concat(F.col("low"), F.lit(" ("), F.col("pos"), F.lit(" → "), F.col("route.category"), F.lit(")"))).alias("fallback"),
    )


KEYS = ["text", "lemma", "pos", "tag", "is_ent"]


#: A word is frequent if it makes up more than one in so many tokens for each shuffle partition.
FREQUENT = 4


def transcribe(tokens: DataFrame, brain: DataFrame) -> DataFrame:
    """Tokens with their word: distinct tokens are worked out once and joined back.

    The words of a text are uneven: one may make up half of all tokens, and an equi-join would send these to one task.
    So tokens are counted as they are made distinct, and the words of frequent ones, fewer than FREQUENT times the shuffle
    partitions by what frequent means, are broadcast.  The rest meet their words by shuffle, by a hash of the token; a token
    that has its word already is dealt by its place instead, so it goes anywhere.  Tokens with nulls keep them.
    """
    partitions = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = tokens.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    total = counted.agg(F.sum("_n").alias("_all"))  # one row
    results = ["word", "missing", "fallback"]
    same = lambda left, right: functools.reduce(lambda a, b: a & b, [left(k).eqNullSafe(right(k)) for k in KEYS])
    named = lambda df, mark: df.select(*[F.col(k).alias(f"_{mark}_{k}") for k in KEYS], F.struct(*results).alias(f"_{mark}"))
    frequent = counted.crossJoin(F.broadcast(total)).where(F.col("_n") * (FREQUENT * partitions) > F.col("_all")).select(*KEYS)
    few = named(transcribed_words(frequent, brain), "few")
    many = named(transcribed_words(counted.select(*KEYS), brain), "many").withColumn("_to", F.xxhash64(*[f"_many_{k}" for k in KEYS]))
    met = tokens.join(F.broadcast(few), same(lambda k: F.col(k), lambda k: F.col(f"_few_{k}")), "left")
    met = met.withColumn("_at", F.when(F.col("_few").isNull(), F.xxhash64(*KEYS)).otherwise(F.xxhash64("doc_id", "tok_idx")))
    met = met.join(many, (F.col("_at") == F.col("_to")) & same(lambda k: F.col(k), lambda k: F.col(f"_many_{k}")), "left")
    word = F.coalesce("_few", "_many")
    return met.select(*KEYS, *[c for c in tokens.columns if c not in KEYS], *[word[r].alias(r) for r in results])


def reassembled(transcribed: DataFrame) -> DataFrame:
    """doc_id and text: words and white space in token order."""
    piece = F.struct("tok_idx", F.concat("word", F.coalesce("whitespace", F.lit(""))).alias("piece"))
    return transcribed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["piece"]), "").alias("text"))


def missing_words(transcribed: DataFrame) -> DataFrame:
    return transcribed.where(F.col("missing").isNotNull()).select(F.col("missing").alias("word")).distinct().orderBy("word")


def fallback_words(transcribed: DataFrame) -> DataFrame:
    return transcribed.where(F.col("fallback").isNotNull()).select(F.col("fallback").alias("line")).distinct().orderBy("line")


def unmatched(tokens: DataFrame, brain: DataFrame) -> DataFrame:
    """Tokens that the lexicon has neither by text nor by lemma: two anti joins."""
    lemmas = brain.select(F.col("eng").alias("key")).distinct()
    return tokens.join(lemmas, F.lower("text") == F.col("key"), "left_anti").join(lemmas, F.lower("lemma") == F.col("key"), "left_anti")


# -- a rule tagger, for where no trained one is at hand -----------------------------------------------------

# Function words and their tags.
FUNCTION_WORDS = {
    "DET": ("DT", "the a an this that these those"), "PRON": ("PRP", "i you he she it we they me him her us them"), "ADP": ("IN", "of in on at by for with from to into"),
    "CCONJ": ("CC", "and or but nor"), "SCONJ": ("IN", "because if while although"), "AUX": ("VB", "is are was were be been am do does did have has had can could will would"), "PART": ("RB", "not n't"),
}


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of whole texts by deterministic rules: words, numbers, marks, and what white space follows; and the columns to ``keep``.

    Any trained tagger that gives the same columns can stand here instead.
    """
    text = F.col(text_col)
    each = docs.select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(F.regexp_extract_all(text, F.lit(r"(n['’]t|['’][A-Za-z]+|[^\W\d_]+?(?=n['’]t)|[^\W\d_]+|[0-9]+|[^\w\s]|_)(\s*)".replace(r"[^\W\d_]", r"\p{L}").replace(r"[^\w\s]", r"[^\p{L}0-9_\s]")), F.lit(0))).alias("tok_idx", "piece"))
    word = F.regexp_replace("piece", r"\s+$", "")
    rows = each.withColumn("t", word).withColumn("whitespace", F.regexp_extract("piece", r"(\s*)$", 1)).withColumn("low", F.lower("t"))
    pos = F.when(~F.col("low").rlike(r"[\p{L}0-9]"), F.struct(F.lit("PUNCT").alias("pos"), F.lit(".").alias("tag"))).when(F.col("low").rlike("^[0-9]"), F.struct(F.lit("NUM").alias("pos"), F.lit("CD").alias("tag")))
    pair = lambda p, t: F.struct(F.lit(p).alias("pos"), F.lit(t).alias("tag"))
    for p, (t, words) in FUNCTION_WORDS.items():
        pos = pos.when(F.col("low").isin(*words.split()), pair(p, t))
    pos = (
        pos.when(F.col("low").rlike("..ing$"), pair("VERB", "VBG")).when(F.col("low").rlike("..ed$"), pair("VERB", "VBD")).when(F.col("low").rlike("..ly$"), pair("ADV", "RB"))
        .when(F.col("low").rlike("..(ous|ful|ive|able|ible|al)$"), pair("ADJ", "JJ")).when(F.col("low").rlike("[^s]s$"), pair("NOUN", "NNS")).otherwise(pair("NOUN", "NN"))
    )
    rows = rows.withColumn("p", pos)
    lemma = F.when(F.col("p.tag") == "NNS", F.regexp_replace("low", "s$", "")).when(F.col("p.tag") == "VBG", F.regexp_replace("low", "ing$", "")).when(F.col("p.tag") == "VBD", F.regexp_replace("low", "ed$", "")).otherwise(F.col("low"))
    return rows.select("doc_id", "tok_idx", F.col("t").alias("text"), lemma.alias("lemma"), "p.pos", "p.tag", F.lit(False).alias("is_ent"), "whitespace", *keep)
