"""Stanzas of an entry file, and the typed record of each, parsed in batches by Arrow.

A record: file, stanza_idx, me_word, reformed_word, pos, conj_kind, conjugations, etymology, sources, warnings.
``conj_kind`` tells which fields of ``conjugations`` count: slot, explicit, noun, forms or empty.  Null is absent;
an empty string is a slot without a form.  The total order of records is (file, stanza_idx).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_blanks

POS_AT_END = r"\((?P<pos>[a-z][a-z ,]*)\)[ \t]*\z"
SLOTTED, VERBISH = ("v", "tr v", "intr v"), ("v", "tr v", "intr v", "aux", "auxiliary", "modal")
NOUNISH = ("n", "noun", "m n", "f n", "masculine noun", "feminine noun", "neuter noun")
SLOTS = ("present", "third_singular", "past", "participle", "gerund")
CONJ = "struct<present:string,third_singular:string,past:string,participle:string,gerund:string,explicit:array<struct<eng:string,ing:string>>,plural:string,variants:array<string>,forms:array<string>>"


def paragraphs(text: Column) -> Column:
    """Runs of lines between empty lines; a line of blanks isn't empty."""
    return F.array_remove(F.split(F.btrim(text, F.lit("\n")), r"\n\n+"), "")


def stanzas(files: DataFrame) -> DataFrame:
    """file, stanza_idx (from 1), stanza."""
    return files.select("file", F.posexplode(paragraphs(F.col("text"))).alias("p", "stanza")).select("file", (F.col("p") + 1).alias("stanza_idx"), "stanza")


def clean_lines(stanza: Column) -> Column:
    return F.array_remove(F.split(F.replace(stanza, F.lit("\r"), F.lit("")), "\n"), "")


def is_url(line: Column) -> Column:
    return line.startswith("http")


def is_reformed(line: Column) -> Column:
    # a search for the bracket is far cheaper than the pattern, and most lines have one of the two brackets only
    return line.contains("(") & ~is_url(line) & line.rlike(r"\([a-z]") & ~(line.contains("[") & line.rlike(r"\[[A-Z]"))


def etymology_of(lines: Column) -> Column:
    tagged = F.filter(lines, lambda x: ~is_url(x) & ~is_reformed(x))
    named = F.transform(tagged, lambda x: F.struct(x.alias("x"), F.regexp_extract(x, r"\[([A-Z]+)\]", 1).alias("lang")))
    # a line nearly always has one tag; the pattern is tried again only where a bracket is left
    bare = F.transform(named, lambda e: F.struct(e["x"].alias("x"), F.replace(e["x"], F.concat(F.lit("["), e["lang"], F.lit("]")), F.lit("")).alias("bare"), e["lang"].alias("lang")))
    form = lambda e: F.when(e["lang"] == "", e["x"]).when(e["bare"].contains("["), F.regexp_replace(e["x"], r"\[[A-Z]+\]", "")).otherwise(e["bare"])
    entries = F.transform(bare, lambda e: F.struct(trim_blanks(form(e)).alias("form"), e["lang"].alias("lang")))
    return F.filter(entries, lambda e: e["form"] != "")


def tags(pos: Column) -> Column:
    """Comma tags of a part of speech."""
    return F.filter(F.transform(F.split(pos, ","), trim_blanks), lambda t: t != "")


def origin(etymology: Column) -> Column:
    """The last entry in Modern or Middle English, else the last of all."""
    return F.coalesce(F.try_element_at(F.filter(etymology, lambda e: e["lang"].isin("ME", "MI")), F.lit(-1)), F.try_element_at(etymology, F.lit(-1)))


#: Columns of a record, and what each group of them is derived from.
COLUMNS = ("file", "stanza_idx", "me_word", "reformed_word", "pos", "conj_kind", "conjugations", "etymology", "sources", "warnings")
KINDS = {"conj_kind", "conjugations", "warnings"}
ENGLISH = {"me_word", *KINDS}
TYPES = {"file": "string", "stanza_idx": "int", "conjugations": CONJ, "etymology": "array<struct<form:string,lang:string>>", "sources": "array<string>", "warnings": "array<string>"}


def parse(files: DataFrame, *columns: str) -> DataFrame:
    """Records of the stanzas that have a reformed line; ``files`` has file and text.

    With ``columns`` the records have these alone, and what no one of them needs isn't worked out.  Lambdas over the lines
    of each stanza are interpreted, one element after another, so a batch of stanzas is parsed at once, by Arrow's functions.
    """
    wanted = columns or COLUMNS
    return stanzas(files).mapInArrow(_parser(wanted), ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in wanted))


def _none_empty(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of lists that aren't empty, and the list each is from."""
    values = lists.flatten()
    some = pc.greater(pc.binary_length(values), 0)
    return values.filter(some), pc.list_parent_indices(lists).filter(some).to_numpy()


def _lists(values: pa.Array, rows: np.ndarray, n: int, absent: bool = False) -> pa.ListArray:
    """A list for each of ``n`` rows from values in the order of their rows; ``absent``: null where there are none."""
    counts = np.bincount(rows, minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(counts == 0)) if absent else pa.ListArray.from_arrays(offsets, values)


def _at(values: pa.Array, places: np.ndarray, there: np.ndarray) -> pa.Array:
    """The values at ``places``, null where none is there."""
    return values.take(pa.array(places, pa.int64(), mask=~there))


def _without_to(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(words, r"^[tT][oO][ \t]+", "")


def _spaced(words: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(words, "\t", " "), ",", " ")


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def _parser(wanted: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    need = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _parsed(batch.column("file"), batch.column("stanza_idx"), batch.column("stanza"), need)
            yield pa.RecordBatch.from_arrays([made[c] for c in wanted], names=list(wanted))

    return run


def _parsed(file: pa.Array, stanza_idx: pa.Array, stanza: pa.Array, need: set[str]) -> dict[str, pa.Array]:
    """The wanted columns of the records in a batch of stanzas."""
    lines, of = _none_empty(pc.split_pattern(pc.replace_substring(stanza, "\r", ""), "\n"))
    url = _mask(pc.starts_with(lines, "http"))
    reformed = _mask(pc.match_substring(lines, "(")) & ~url  # the bracket is found far faster than the patterns
    likely = lines.filter(pa.array(reformed))
    reformed[reformed] = _mask(pc.match_substring_regex(likely, r"\([a-z]")) & ~_mask(pc.match_substring_regex(likely, r"\[[A-Z]"))
    last = np.full(len(stanza), -1)
    last[of[reformed]] = np.flatnonzero(reformed)  # the last one of a stanza stays
    kept = last >= 0
    n, place = int(kept.sum()), np.cumsum(kept) - 1
    line = lines.take(pa.array(last[kept]))
    made = {"file": file.filter(pa.array(kept)), "stanza_idx": stanza_idx.filter(pa.array(kept))}
    made["pos"] = pos = pc.fill_null(pc.struct_field(pc.extract_regex(line, POS_AT_END), "pos"), "")
    if "sources" in need:
        urls = url & kept[of]
        made["sources"] = _lists(lines.filter(pa.array(urls)), place[of[urls]], n)
    if need & {"etymology", *ENGLISH}:
        tagged = ~url & ~reformed & kept[of]
        x, rows = lines.filter(pa.array(tagged)), place[of[tagged]]
        form = pc.ascii_trim(pc.replace_substring_regex(x, r"\[[A-Z]+\]", ""), characters=" \t")
        lang = pc.fill_null(pc.struct_field(pc.extract_regex(x, r"\[(?P<lang>[A-Z]+)\]"), "lang"), "")
        some = pc.greater(pc.binary_length(form), 0)
        form, lang, rows = form.filter(some), lang.filter(some), rows[_mask(some)]
        made["etymology"] = _lists(pa.StructArray.from_arrays([form, lang], names=["form", "lang"]), rows, n)
    if need & {"reformed_word", *KINDS}:  # the reformed line without its part of speech
        bare = pc.ascii_trim(pc.replace_substring_regex(line, POS_AT_END, ""), characters=" \t")
        toks, row = _none_empty(pc.split_pattern(_spaced(_without_to(bare)), " "))
        count = np.bincount(row, minlength=n)
        start = np.cumsum(count) - count
        word = pc.fill_null(_at(toks, start, count > 0), "")
        made["reformed_word"] = pc.replace_substring_regex(word, r"[.,]\z", "")
    if need & ENGLISH:
        first = np.full((3, n), -1)
        for i, tag in enumerate(("ME", "MI")):
            found = np.flatnonzero(_mask(pc.equal(lang, tag)))[::-1]
            first[i, rows[found]] = found  # the first one stays, as it comes last
        first[2, rows] = np.arange(len(rows))
        chosen = np.where(first[0] >= 0, first[0], np.where(first[1] >= 0, first[1], first[2]))
        me = _spaced(_without_to(pc.fill_null(_at(form, chosen, chosen >= 0), "")))
        made["me_word"] = pc.list_element(pc.split_pattern(me, " ", max_splits=1), 0)
    if need & KINDS:
        made |= _conjugations(toks, row, count, start, me, first[0] >= 0, pos)
    return made


def _conjugations(toks: pa.Array, row: np.ndarray, count: np.ndarray, start: np.ndarray, me: pa.Array, real_me: np.ndarray, pos: pa.Array) -> dict[str, pa.Array]:
    """conj_kind, conjugations and warnings from the tokens of the reformed lines (``row`` of each, their ``count`` and ``start``), the English words, and what the tags say."""
    n = len(count)
    nth = np.arange(len(toks)) - start[row] + 1
    me_toks, me_row = _none_empty(pc.split_pattern(me, " "))
    coded = pos.dictionary_encode()
    tags = [{t.strip(" \t") for t in p.split(",")} for p in coded.dictionary.to_pylist()]
    slotted, verbish, nounish = (np.array([bool(t & set(some)) for t in tags], bool)[coded.indices.to_numpy()] for some in (SLOTTED, VERBISH, NOUNISH))
    suffix, bracket = _mask(pc.starts_with(toks, "-")), _mask(pc.ends_with(toks, "(s"))
    any_of = lambda found: np.bincount(row[found], minlength=n) > 0
    at = lambda i, where: _at(toks, start + i - 1, where & (count >= i))
    plain = ~any_of((suffix | bracket) & (nth >= 2))
    explicit = verbish & real_me & (np.bincount(me_row, minlength=n) == count) & (count > 1) & plain
    slot = verbish & slotted & ~explicit
    stemmed = slot & any_of(bracket & (nth == 2))
    over = slot & ~stemmed & (count > 5)
    given = slot & ~stemmed & ~over
    noun = nounish & ~verbish & (count >= 2)
    led = noun & any_of(suffix & (nth == 2))
    named = noun & ~led
    forms = ~verbish & ~nounish & (count >= 2)
    kind = np.select([explicit, stemmed | given, noun, forms], ["explicit", "slot", "noun", "forms"], "empty")
    # the place of the first suffix after the second token, else of the last token
    plural_at = count.copy()
    marked = np.flatnonzero(suffix & (nth >= 3))[::-1]
    plural_at[row[marked]] = nth[marked]
    stem = pc.replace_substring_regex(at(2, stemmed), r"\(s\z", "")
    # per slot: the token it takes in each shape, by how many there are; 0 is an empty text
    by_count = lambda *places: np.array(places)[np.minimum(count, 5)]
    past = np.where(stemmed, 3, by_count(0, 0, 0, 0, 3, 3))
    participle = np.where(stemmed, by_count(3, 3, 3, 3, 3, 4), by_count(0, 0, 0, 0, 3, 4))
    gerund = np.where(stemmed, by_count(4, 4, 4, 4, 4, 5), by_count(0, 0, 0, 3, 4, 5))
    slots = stemmed | given
    taken = lambda i: pc.if_else(pa.array(slots), pc.fill_null(at(i, slots & (i > 0)), ""), pa.scalar(None, pa.string()))
    third = pc.if_else(pa.array(given), pc.fill_null(at(2, given), "-s"), pc.binary_join_element_wise(stem, "s", ""))
    listed = lambda found: _lists(toks.filter(pa.array(found)), row[found], n, absent=True)
    pairs = explicit[row] & (nth >= 2)
    me_count = np.bincount(me_row, minlength=n)
    me_pairs = explicit[me_row] & (np.arange(len(me_toks)) - (np.cumsum(me_count) - me_count)[me_row] >= 1)
    paired = pa.StructArray.from_arrays([me_toks.filter(pa.array(me_pairs)), toks.filter(pa.array(pairs))], names=["eng", "ing"])
    fields = {
        "present": pc.if_else(pa.array(given), "", stem), "third_singular": third, "past": taken(past), "participle": taken(participle), "gerund": taken(gerund),
        "explicit": _lists(paired, row[pairs], n, absent=True), "plural": at(np.where(led, 2, plural_at), noun),
        "variants": listed(named[row] & (nth >= 2) & (nth < plural_at[row])), "forms": listed(led[row] & (nth >= 3) | forms[row] & (nth >= 2)),
    }
    told = over[row]
    warned = pc.binary_join(_lists(toks.filter(pa.array(told)), row[told], n).filter(pa.array(over)), " ")
    return {
        "conj_kind": pa.array(kind, pa.string()), "conjugations": pa.StructArray.from_arrays(list(fields.values()), names=list(fields)),
        "warnings": _lists(pc.binary_join_element_wise("over five forms: ", warned, ""), np.flatnonzero(over), n),
    }


def rejects(files: DataFrame) -> DataFrame:
    """Stanzas without a reformed line: what :func:`parse` leaves out, for the accounts."""
    rows = stanzas(files)
    return rows.where(~F.exists(clean_lines(F.col("stanza")), is_reformed))


def conj_leaves(kind: Column, conj: Column) -> Column:
    """All strings of the conjugations in the order of the record."""
    slots = F.array(*[F.coalesce(conj[s], F.lit("")) for s in SLOTS])
    none = F.array().cast("array<string>")
    flat = lambda *xs: F.concat(*[F.coalesce(x, none) for x in xs])
    return F.when(kind == "slot", slots).otherwise(
        flat(F.transform(conj["explicit"], lambda p: p["ing"]), F.when(conj["plural"].isNotNull(), F.array(conj["plural"])), conj["forms"], conj["variants"])
    )


def cards(files: DataFrame) -> DataFrame:
    """The page view of an entry: a line of blanks does break, the last two lines that are no URLs are English and reformed."""
    split = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")
    rows = files.select("file", F.posexplode(split).alias("p", "stanza")).select("file", (F.col("p") + 1).alias("stanza_idx"), "stanza")
    lines = F.filter(F.transform(F.split("stanza", r"\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = rows.withColumn("lines", F.filter(lines, lambda x: ~is_url(x))).withColumn("urls", F.filter(lines, is_url))
    last = F.coalesce(F.try_element_at("lines", F.lit(-1)), F.lit(""))
    return rows.select(
        "file", "stanza_idx", F.coalesce(F.try_element_at("lines", F.lit(-2)), F.lit("")).alias("english"),
        F.when(last.rlike(r"^(.*)\s+\((.*)\)$"), F.regexp_extract(last, r"^(.*)\s+\((.*)\)$", 1)).otherwise(last).alias("word"),
        F.regexp_extract(last, r"^(.*)\s+\((.*)\)$", 2).alias("pos"),
        F.slice("lines", 1, F.greatest(F.size("lines") - 2, F.lit(0))).alias("evolution"), "urls",
    )


def stanza_text(files: DataFrame) -> DataFrame:
    """Each stanza under its number, for display."""
    return stanzas(files).select("file", "stanza_idx", F.concat(F.lit("Stanza "), F.col("stanza_idx").cast("string"), F.lit(":\n"), F.col("stanza"), F.lit("\n")).alias("shown"))
