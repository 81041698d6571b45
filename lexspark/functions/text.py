"""Text as Column expressions: nothing here leaves the JVM but :func:`nfc`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, all else kept."""
    return F.translate(c, UPPER, LOWER)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode canonical composition; Spark has no such function."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def trim_blanks(c: Column) -> Column:
    """Spaces and tabs off both ends."""
    return F.btrim(c, F.lit(" \t"))


def without_to(c: Column) -> Column:
    """One leading infinitive marker off."""
    return let(c, lambda x: F.when(F.lower(F.left(x, F.lit(2))) == "to", F.regexp_replace(x, r"^[tT][oO][ \t]+", "")).otherwise(x))


def tokens(c: Column) -> Column:
    """Words between blanks and commas."""
    return F.array_remove(F.split(F.translate(c, "\t,", "  "), " "), "")


def reformed_upper(c: Column) -> Column:
    """Upper case of the reformed orthography, whose capital thorn has a letter of its own."""
    return F.upper(F.translate(c, "þ", "Ћ"))


def resolve_form(form: Column, root: Column, gerund: Column | bool = False) -> Column:
    """An inflected form: the form itself, or a ``-suffix`` joined to ``root`` by the rules for a silent ending.

    null or empty form -> null; a form that isn't a suffix loses its parentheses; a suffix without a root stays as it is.
    """
    is_gerund = gerund if isinstance(gerund, Column) else F.lit(gerund)
    suffix = F.regexp_replace(form, "^-", "")
    short = lambda n: F.substr(root, F.lit(1), F.length(root) - n)
    stem = (
        F.when(root.endswith("ie") & suffix.startswith("i") & is_gerund, F.concat(short(2), F.lit("y")))
        .when(root.endswith("ie") & (suffix == "is"), short(2))
        .when(root.rlike("(ue|che)$") & (suffix == "s"), short(2))
        .when(root.endswith("e") & (is_gerund | suffix.rlike("^[aeiouy]")), short(1))
        .otherwise(root)
    )
    return (
        F.when(form.isNull() | (form == ""), F.lit(None).cast("string"))
        .when(~form.startswith("-"), F.regexp_replace(form, "[()]", ""))
        .when(root.isNull() | (root == ""), form)
        .otherwise(F.concat(stem, suffix))
    )


def match_casing(original: Column, replacement: Column) -> Column:
    """``replacement`` in the case of ``original``, judged by its ASCII letters; one capital letter alone is all capitals."""
    letters = F.regexp_replace(original, "[^a-zA-Z]", "")
    first = F.concat(reformed_upper(F.substring(replacement, 1, 1)), F.substr(replacement, F.lit(2)))
    return (
        F.when(original.isNull() | (original == ""), replacement)
        .when(replacement.isNull() | (replacement == ""), original)
        .when(letters == "", replacement)
        .when(letters == F.translate(letters, LOWER, UPPER), reformed_upper(replacement))
        .when(letters.rlike("^[A-Z]"), first)
        .otherwise(replacement)
    )


def title(slug: Column) -> Column:
    """Words of a slug with their first letters raised, the rest kept."""
    return F.array_join(F.transform(F.split(slug, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def strip_ext(path: Column) -> Column:
    """A path without its last extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def swap_ext(path: Column, ext: str) -> Column:
    return F.concat(strip_ext(path), F.lit("." + ext.lstrip(".")))


def mirrored(path: Column, base_in: str, base_out: str, ext: str) -> Column:
    """Where the result for ``path`` goes: the same place below another folder, with another extension."""
    inside = F.regexp_replace(path, "^" + base_in.rstrip("/") + "/?", "")
    return F.concat(F.lit(base_out.rstrip("/") + "/"), swap_ext(inside, ext))


def trimmed_lines(text: Column) -> Column:
    """White space off the end of every line."""
    return F.regexp_replace(text, r"(?m)[ \t\r\f\x0B]+$", "")


def url_domain(url: Column) -> Column:
    """Host for display: ``https://`` and ``www.`` off, up to the first slash."""
    return F.split_part(F.replace(F.replace(url, F.lit("https://www."), F.lit("")), F.lit("https://"), F.lit("")), F.lit("/"), F.lit(1))


def is_clitic(raw_lower: Column) -> Column:
    return raw_lower.rlike("^(?:['’][a-z]+|n['’]t)$")


def pos_full(tag: Column, names: dict[str, str]) -> Column:
    """Each comma tag of ``(a, b)`` by its full name, or itself, joined by commas."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    tags = F.transform(F.split(F.regexp_replace(tag, "[()]", ""), ","), lambda t: F.trim(t))
    return F.array_join(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), t)), ",")


def glyph_slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\s+", "_")
