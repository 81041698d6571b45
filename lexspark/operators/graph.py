"""The etymology graph: nodes, edges, and a diagram of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import held
from ..sources.shared import shared_folder

PROJECT = "Reformed"


def chains(records: DataFrame, project: str = PROJECT) -> DataFrame:
    """ord and chain: the etymology of a record and then its reformed word; a record without etymology makes none."""
    old = F.transform("etymology", lambda e: F.struct(e["form"].alias("label"), e["lang"].alias("lang"), F.lit("").alias("pos")))
    new = F.array(F.struct(F.col("reformed_word").alias("label"), F.lit(project).alias("lang"), F.col("pos")))
    return records.where(F.size("etymology") > 0).select(F.struct("file", "stanza_idx").alias("ord"), F.concat(old, new).alias("chain"))


def _ids(chain: str) -> Column:
    return F.transform(chain, lambda n: F.concat_ws("_", n["label"], n["lang"]))


def _pairs(ids: str) -> Column:
    return F.arrays_zip(F.slice(ids, F.lit(1), F.size(ids) - 1).alias("source"), F.slice(ids, F.lit(2), F.size(ids) - 1).alias("target"))


def nodes(records: DataFrame, project: str = PROJECT) -> DataFrame:
    """id, label, lang, pos: the first of each id in the order of the records."""
    each = chains(records, project).select("ord", F.posexplode("chain").alias("i", "n"))
    keyed = each.select(F.concat_ws("_", "n.label", "n.lang").alias("id"), F.struct("ord", "i").alias("at"), "n")
    return keyed.groupBy("id").agg(F.min_by("n", "at").alias("n")).select("id", "n.label", "n.lang", "n.pos")


def links(records: DataFrame, project: str = PROJECT) -> DataFrame:
    """source, target: neighbours in a chain, as often as they are."""
    return held(chains(records, project), ids=_ids("chain")).select(F.explode(_pairs("ids")).alias("e")).select("e.source", "e.target")


def edges(records: DataFrame, project: str = PROJECT) -> DataFrame:
    """source, target: neighbours in a chain, each pair once."""
    return links(records, project).distinct()


def parts(records: DataFrame, project: str = PROJECT) -> DataFrame:
    """source, target, at, n: nodes (no target; their place and what they hold) and neighbours (neither) of every chain, as often as they are, in one pass."""
    each = held(chains(records, project), ids=_ids("chain"))
    node = F.transform("chain", lambda n, i: F.struct(F.get("ids", i).alias("source"), F.lit(None).cast("string").alias("target"), F.struct("ord", i.alias("i")).alias("at"), n.alias("n")))
    no_place, no_node = F.when(F.lit(False), F.struct("ord", F.lit(0).alias("i"))), F.when(F.lit(False), F.get("chain", F.lit(0)))
    link = F.transform(_pairs("ids"), lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), no_place.alias("at"), no_node.alias("n")))
    return each.select(F.explode(F.concat(node, link)).alias("e")).select("e.*")


def json_lines(records: DataFrame, project: str = PROJECT) -> DataFrame:
    """kind (node or edge) and json of each."""
    once = parts(records, project).groupBy("source", "target").agg(F.min_by("n", "at").alias("n"))
    node = F.to_json(F.struct(F.col("source").alias("id"), "n.label", "n.lang", "n.pos"))
    is_node = F.col("target").isNull()
    return once.select(F.when(is_node, "node").otherwise("edge").alias("kind"), F.when(is_node, node).otherwise(F.to_json(F.struct("source", "target"))).alias("json"))


def neighbour_pairs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """source, target, n: values that follow each other in a key's rows, with how often they do."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.select(before.alias("source"), F.col(value).alias("target")).where(F.col("source").isNotNull()).groupBy("source", "target").agg(F.count("*").alias("n"))


def _stored(rows: DataFrame, folder: str, step: str) -> DataFrame:
    """``rows`` written below ``folder`` and read again: the plan ends there, and a lost executor reads what was written."""
    rows.write.mode("overwrite").parquet(f"{folder}/{step}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{step}")


def _numbered(ids: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """id and n, a long that no two ids share, and the seed of the hash that gave it: one that clashes is followed by another."""
    seed = 42
    while True:
        named = _stored(ids.select("id", F.xxhash64("id", F.lit(seed)).alias("n")), folder, f"ids-{seed}")
        if named.groupBy("n").agg(F.count("*").alias("ids")).where("ids > 1").isEmpty():
            return named, seed
        seed += 1


def _stirred(c: Column, step: int) -> Column:
    """Another long for each long, and by the same call back: an order of hashes for each step."""
    return c.bitwiseXOR(F.lit(0x1E3779B97F4A7C15 * (2 * step + 1) % (1 << 63)))


def families(links: DataFrame) -> DataFrame:
    """id and family (the least id that can be reached over links of either direction) for every id of ``links`` (source, target).

    Ids become longs of their hashes, checked to be told apart.  Each round merges a node into the first of itself and its
    neighbours, in an order drawn anew, and the links between what is left are a set of fewer: rounds grow as the logarithm
    of the nodes, and nearly all rows are moved in the first.  Names are met again at the end.  First neighbours are found
    by partial aggregation and stored, so that adaptive execution can split the links of a hub.

    A link with a null end is none; a link of an id to itself gives a family of its own; no links give no rows.
    """
    folder = shared_folder(links.sparkSession, "families")
    raw = _stored(links.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select("source", "target"), folder, "links")
    named, seed = _numbered(raw.select(F.explode(F.array("source", "target")).alias("id")).distinct(), folder)
    a, b = (F.xxhash64(c, F.lit(seed)) for c in ("source", "target"))
    now = _stored(raw.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), folder, "0/links")
    merged = []
    while not now.isEmpty():
        step = len(merged) + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_stirred(F.col("b"), step)).alias("m"))
        to = _stored(first.select(F.col("a").alias("x"), _stirred(F.least("m", _stirred(F.col("a"), step)), step).alias("y")), folder, f"{step}/first")
        merged.append(to)
        half = now.join(to, F.col("a") == F.col("x")).select(F.col("y").alias("c"), "b").distinct()
        left = half.join(to, F.col("b") == F.col("x")).select("c", F.col("y").alias("d")).where("c <> d")
        now = _stored(left.select(F.greatest("c", "d").alias("a"), F.least("c", "d").alias("b")).distinct(), folder, f"{step}/links")
    if not merged:
        return named.select("id", F.col("id").alias("family"))
    root = merged.pop().withColumnRenamed("y", "root")
    while merged:  # from the last round back: a name that no later round has is final
        step = len(merged)
        later = root.select(F.col("x").alias("then"), "root")
        root = _stored(merged.pop().join(later, F.col("y") == F.col("then"), "left").select("x", F.coalesce("root", "y").alias("root")), folder, f"{step}/roots")
    of = _stored(named.join(root, F.col("n") == F.col("x"), "left").select("id", F.coalesce("root", "n").alias("root")), folder, "of")
    least = of.groupBy("root").agg(F.min("id").alias("family"))
    return of.join(least, "root").select("id", "family")


def mermaid(records: DataFrame, project: str = PROJECT) -> DataFrame:
    """One row, ``diagram``: the graph of the given records as text; meant for the few records of a word."""
    node = nodes(records, project).select(F.lit(1).alias("part"), F.concat(F.lit("  "), "id", F.lit('["'), "label", F.lit("<br><b>["), "lang", F.lit(']</b>"]')).alias("line"))
    edge = edges(records, project).select(F.lit(2).alias("part"), F.concat(F.lit("  "), "source", F.lit(" --> "), "target").alias("line"))
    lines = node.unionByName(edge)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit("graph LR\n"), body).alias("diagram"))


def document(records: DataFrame, project: str = PROJECT) -> DataFrame:
    """One row, ``json``: {"nodes": [...], "edges": [...]} of the given records, sorted; meant for a few of them."""
    both = nodes(records, project).agg(F.array_sort(F.collect_list(F.struct("id", "label", "lang", "pos"))).alias("nodes"))
    both = both.crossJoin(edges(records, project).agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("edges")))  # one row each
    return both.select(F.to_json(F.struct("nodes", "edges")).alias("json"))


def graph_counts(records: DataFrame, project: str = PROJECT) -> DataFrame:
    """nodes and edges, counted in one pass and one shuffle."""
    each = held(chains(records, project), ids=_ids("chain"))
    node = F.transform("ids", lambda x: F.struct(x.alias("source"), F.lit(None).cast("string").alias("target")))
    once = each.select(F.explode(F.concat(node, _pairs("ids"))).alias("e")).select("e.source", "e.target").distinct()
    return once.agg(F.count_if(F.col("target").isNull()).alias("nodes"), F.count("target").alias("edges"))
