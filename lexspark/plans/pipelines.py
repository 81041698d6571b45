"""Whole workflows composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, brain, histories, stanzas, translate
from ..sources import readers, sinks


def build_dictionary(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Entry files to the compiled lexicon, written as Parquet."""
    records = stanzas.parse(readers.text_files(spark, root))
    compiled = brain.compile_brain(records)
    sinks.write_brain(compiled, out)
    return spark.read.parquet(out)


def translate_books(tokens: DataFrame, lexicon: DataFrame) -> dict[str, DataFrame]:
    """Texts and the two audits of a token table."""
    done = translate.transcribe(tokens, lexicon)
    return {"texts": translate.reassembled(done), "missing": translate.missing_words(done), "fallbacks": translate.fallback_words(done)}


def create_histories(spark: SparkSession, root: str, out: str | None = None, dirs: list[str] | None = None, say=None) -> DataFrame:
    """History files of a dictionary; without ``out`` a dry run.  ``say`` is told each name."""
    found = histories.split_histories(readers.text_files(spark, root), dirs)
    names = sinks.write_histories(found, out or "", dry_run=not out) if out or say else []
    for name in names if say else []:
        say(name)
    return found


def summary_json(records: DataFrame) -> DataFrame:
    """One row, ``json``: the three statistics, each commonest first; they have a row for each tag, language or pair."""
    held = None
    for name, rows in analytics.summary(records).items():
        keys = [c for c in rows.columns if c != "count"]
        order = F.struct((-F.col("count")).alias("n"), *[F.coalesce(c, F.lit("")).alias(f"k{i}") for i, c in enumerate(keys)], F.struct(*keys, "count").alias("row"))
        listed = rows.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]).alias(name))
        held = listed if held is None else held.crossJoin(listed)  # one row each
    return held.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def summary_text(records: DataFrame, top: int = 5) -> str:
    """The report a reader sees: counts by part of speech and language, and the commonest against each other."""
    parts = analytics.summary(records)
    lines = ["Parts of speech"] + [f"  {r.tag or '(none)'}  {r['count']}" for r in parts["parts_of_speech"].collect()]  # a row for each tag
    lines += ["Languages"] + [f"  {r.lang or '?'}  {r['count']}" for r in parts["languages"].collect()]
    cells = {(r.tag, r.lang): r["count"] for r in analytics.cross_tab_report(records, top).collect()}  # top x top cells
    tags, langs = sorted({t for t, _ in cells}), sorted({g for _, g in cells})
    lines += ["\t".join(["", *langs])] + ["\t".join([t, *[str(cells[t, g]) for g in langs]]) for t in tags]
    return "\n".join(lines)
