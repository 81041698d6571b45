"""Time-ordered target encoding: rates of a target over a key's earlier history in other folds, by a dyadic time tree.

History is summed by key, fold and instant.  Time is cut into leaves; over a key's leaves stands a binary tree, each
of whose nodes sums an aligned run of 2^level leaves.  The leaves before a probe's own are the disjoint union of one
node for each set bit of its leaf's number, so a probe explodes into logarithmically many nodes and finds their sums by
an equi-join.  Inside the probe's leaf, which holds a bounded run of instants, sums run in order.  In the end
the sums of the folds but the probe's own are added up.

Nothing goes through one task: a key's rows are dealt by leaf and by node, whatever share of all rows it has.
A leaf's window sees one row for each instant and fold of a key.  Leaves are narrow for columns of few values, where
they are full, and wide for ids, where they are sparse.

Cases: a null value of a column is a value like others; repeated lines count; lines without an instant must be left out before; without lines, nothing comes back.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import dropped, written

SECOND = 1_000_000
#: Widths of leaves in seconds: for ids and for columns of few values.
WIDE, NARROW = 1 << 21, 1 << 13


@dataclasses.dataclass(frozen=True)
class Encoded:
    """A column to encode: its name, its value (a long or null) and, for text values, ``text``; ``leaf`` in seconds."""

    name: str
    value: Column
    text: Column | None = None
    leaf: int = WIDE


def key_of(columns: list[Encoded]) -> list[str]:
    """What tells the values of all columns apart: value, text if some column has it, and part, which is twice the column's place, and one more for a null.

    The value comes first: sorts compare it before the columns that most rows share.
    """
    return ["value", *["text" for c in columns if c.text is not None][:1], "part"]


def _key(columns: list[Encoded], place: int) -> list[Column]:
    c = columns[place]
    value = c.value.cast("long")
    named = {"value": F.coalesce(value, F.lit(0).cast("long")), "text": F.lit("") if c.text is None else c.text, "part": F.lit(2 * place) + value.isNull().cast("int")}
    return [named[k].alias(k) for k in key_of(columns)]


def instants(lines: DataFrame, columns: list[Encoded]) -> DataFrame:
    """The key, leaf, at, fold, n, s: the sums of ``lines`` (at: microseconds, fold, n, s) for each column."""
    keys = [(*_key(columns, i), F.floor(F.col("at") / (c.leaf * SECOND)).alias("leaf")) for i, c in enumerate(columns)]
    each = lines.select(F.explode(F.array(*[F.struct(*k) for k in keys])).alias("c"), "at", "fold", "n", "s")
    return each.select("c.*", "at", "fold", "n", "s").groupBy(*key_of(columns), "leaf", "at", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def before_leaves(leaves: DataFrame, folds: int, key: list[str]) -> DataFrame:
    """The tree: key, leaf, before_n and before_s: for each fold, the sums of the other folds over all leaves of a key that come before this one.

    ``leaves`` has the sums of each leaf and fold; ``place`` is its number from 0, ``depth`` the levels above it.
    """
    level = F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level")
    node = F.expr("shiftright(place, level)")
    deep = leaves.where("depth > 0")
    # A set bit's node lies left of the probe's own at that level, so none but left children are ever asked for.  A node
    # has a row for each leaf and fold below it at most, so it can be dealt as it will be asked for, and summed there.
    below = deep.select(*key, "place", "fold", "n", "s", level).where(node % 2 == 0).select(*key, "level", node.alias("node"), "fold", "n", "s")
    nodes = below.repartition(*key, "level", "node").groupBy(*key, "level", "node", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    probes = deep.select(*key, "leaf", "place", "depth").distinct().select(*key, "leaf", "place", level).where(node % 2 == 1).select(*key, "leaf", "level", (node - 1).alias("node"))
    met = probes.hint("merge").join(nodes, [*key, "level", "node"])
    sums = met.groupBy(*key, "leaf").agg(*[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}{f}") for f in range(folds) for c in "ns"])
    others = lambda c: F.array(*[sum((F.col(f"{c}{g}") for g in range(folds) if g != f), F.lit(0).cast("long")) for f in range(folds)]).alias(f"before_{c}")
    return sums.select(*key, "leaf", others("n"), others("s"))


def in_order(key: list[str], folds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Running sums inside the leaves, of rows sorted by key, leaf and instant: n and s of other folds' earlier rows, and what came before the leaf.

    Between batches stay the sums of the open leaf by fold, and those before its open instant, so a leaf may have any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, earlier = None, {c: np.zeros(folds, np.int64) for c in "ns"}, dict.fromkeys("ns", 0)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            group, at, fold = [batch.column(c) for c in (*key, "leaf")], batch.column("at").to_numpy(), batch.column("fold").to_numpy()
            other = functools.reduce(np.logical_or, [pc.not_equal(c.slice(1), c.slice(0, rows - 1)).to_numpy(zero_copy_only=False) for c in group])
            open_leaf = last is not None and last[0] == [c[0].as_py() for c in group]
            here = np.arange(rows)
            first = lambda new, open_: np.maximum.accumulate(np.where(np.concatenate([[not open_], new]), here, -1))
            leaf = first(other, open_leaf)  # the first row of each row's leaf and instant, -1 for the open ones
            instant = first(other | (at[1:] != at[:-1]), open_leaf and last[1] == at[0])
            made = {}
            for c in "ns":
                x = batch.column(c).to_numpy()
                total = np.concatenate([[0], np.cumsum(x)])
                every = np.where(leaf >= 0, total[instant] - total[leaf], np.where(instant >= 0, own[c].sum() + total[instant], earlier[c]))
                held = own[c].copy()
                for f in range(folds):
                    mine = np.concatenate([[0], np.cumsum(np.where(fold == f, x, 0))])
                    every -= np.where(fold == f, np.where(leaf >= 0, mine[:-1] - mine[leaf], held[f] + mine[:-1]), 0)
                    own[c][f] = mine[-1] - mine[leaf[-1]] if leaf[-1] >= 0 else held[f] + mine[-1]
                if leaf[-1] >= 0:
                    earlier[c] = total[instant[-1]] - total[leaf[-1]]
                elif instant[-1] >= 0:
                    earlier[c] = held.sum() + total[instant[-1]]
                made[c] = pa.array(every + batch.column(f"before_{c}").to_numpy())
            last = [c[rows - 1].as_py() for c in group], at[-1]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*key, "at", "fold")], *made.values()], names=[*key, "at", "fold", *made])
            yield out.filter(batch.column("asked"))

    return run


def histories(lines: DataFrame, columns: list[Encoded], folds: int, gap: int = 0) -> DataFrame:
    """The key, at, fold, n, s for every instant of ``lines``: the sums of other folds' lines more than ``gap`` microseconds earlier.

    Written to the shared folder, by part.  The extent of each column in time (a row for each) alone reaches the driver.
    """
    key = key_of(columns)
    rows = instants(lines, columns)
    if gap:
        rows = rows.withColumn("asked", F.lit(False)).unionByName(instants(lines.withColumns({"at": F.col("at") - gap, "n": F.lit(0), "s": F.lit(0)}), columns).withColumn("asked", F.lit(True)))
        rows = rows.groupBy(*key, "leaf", "at", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("asked").alias("asked"))
    else:
        rows = rows.withColumn("asked", F.lit(True))
    rows = written(rows, "instants")
    place = F.expr("shiftright(part, 1)")
    ends = {r.column: (r.first, r.last) for r in rows.groupBy(place.alias("column")).agg(F.min("leaf").alias("first"), F.max("leaf").alias("last")).collect()}
    of_part = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), place + 1)
    first, depth = zip(*[(low, (high - low).bit_length()) for low, high in (ends.get(i, (0, 0)) for i in range(len(columns)))])
    leaves = rows.groupBy(*key, "leaf", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    leaves = written(leaves.withColumns({"place": F.col("leaf") - of_part(first), "depth": of_part(depth)}), "leaves")
    # the sums before each leaf are few and are hashed; rows and they are dealt alike, and rows are sorted once, after they met
    none = F.lit(0).cast("long")
    met = rows.repartition(*key, "leaf").join(before_leaves(leaves, folds, key).hint("shuffle_hash"), [*key, "leaf"], "left")
    before = [F.coalesce(F.get(f"before_{c}", F.col("fold").cast("int")), none).alias(f"before_{c}") for c in "ns"]
    met = met.select(*key, "leaf", "at", F.col("fold").cast("int").alias("fold"), "n", "s", "asked", *before).sortWithinPartitions(*key, "leaf", "at")
    kinds = dict(met.dtypes)
    found = met.mapInArrow(in_order(key, folds), ", ".join(f"{c} {kinds[c]}" for c in (*key, "at", "fold", "n", "s")))
    out = written(found, "histories", ["part"])
    dropped(rows, leaves)
    return out


def with_history(rows: DataFrame, found: DataFrame, columns: list[Encoded], name: str, gap: int = 0) -> DataFrame:
    """``rows`` with <name>_n and <name>_s from :func:`histories`; a large group of rows is split by adaptive execution.

    What is found has one row for each value, instant and fold, and is hashed; ``rows`` stream by and need no order.
    """
    part, c = next((i, c) for i, c in enumerate(columns) if c.name == name)
    key = key_of(columns)
    right = found.where(F.col("part").isin(2 * part, 2 * part + 1)).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("at").alias("_at"), F.col("fold").alias("_fold"), F.col("n").alias(f"{name}_n"), F.col("s").alias(f"{name}_s"))
    met = [k == F.col(f"_{name}") for name, k in zip(key, _key(columns, part))]
    on = functools.reduce(Column.__and__, met, (F.col("at") - gap == F.col("_at")) & (F.col("fold") == F.col("_fold")))
    return rows.join(right.hint("shuffle_hash"), on).drop(*[f"_{k}" for k in key], "_at", "_fold")


def rate(n: Column, s: Column, prior: Column, weight: int = 50, whole: int = 1_000_000) -> Column:
    """Share of ``s`` in ``n`` in parts of ``whole``, drawn to the prior as if by ``weight`` more lines; the prior without lines."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", whole * s + weight * prior, n + F.lit(weight).cast("long")))


# -- the shop's tables ---------------------------------------------------------------------------------------

FOLDS = 5


def micros(c: Column) -> Column:
    """Microseconds of a timestamp without a zone since 1970, whatever the session's zone."""
    day = F.unix_date(F.to_date(c)).cast("long") * 86_400
    return (day + F.hour(c) * 3600 + F.minute(c) * 60) * SECOND + (F.extract(F.lit("SECOND"), c) * SECOND).cast("long")


def shop_columns() -> list[Encoded]:
    # kind and segment are told by numbers, see _numbered; a null has a value of its own
    return [
        Encoded("item", F.col("item_id")), Encoded("vendor", F.col("vendor_id")), Encoded("client", F.col("client_id")),
        Encoded("kind", F.col("kind"), None, NARROW), Encoded("nation", F.col("nation_id"), None, NARROW), Encoded("segment", F.col("segment"), None, NARROW),
        Encoded("all", F.lit(0), None, NARROW),
    ]


def _numbered(table: DataFrame, value: str) -> DataFrame:
    """``table`` with a long for each text of a column, by a hash that no two of its texts share: one that clashes is followed by another."""
    texts = written(table.select(value).where(F.col(value).isNotNull()).distinct(), value)
    seed = 42
    while not texts.groupBy(F.xxhash64(value, F.lit(seed)).alias("n")).count().where("count > 1").isEmpty():
        seed += 1
    return table.withColumn(value, F.when(F.col(value).isNotNull(), F.xxhash64(value, F.lit(seed))))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the table's row of that id, null for an id it lacks; of a repeated id, the least value."""
    one = table.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(F.min(value).alias(value))
    if dict(one.dtypes)[value] == "string":
        one = _numbered(one, value)
    # written, so that a shuffle stands right below the join on either side: then a frequent id is split over tasks
    return rows.join(written(one, value).hint("shuffle_hash"), F.col(key) == F.col("_id"), "left").drop("_id")


def sold_lines(sale_lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """A row for each sale, item and vendor: how many lines (n) and returned ones (s), when (at), the fold, and the columns to encode.

    Repeats of a line are summed before anything is moved.  A sale_id that repeats in ``sales`` gives a row for each.
    """
    lines = sale_lines.where(F.col("sale_id").isNotNull()).select(F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), (F.col("flag") == "returned").alias("r"))
    lines = lines.groupBy("sale_id", "item_id", "vendor_id").agg(F.count("*").alias("n"), F.count_if("r").alias("s"))
    lines = _looked_up(_looked_up(lines, items, "item_id", "kind"), vendors, "vendor_id", "nation_id")
    heads = sales.where(F.col("sale_id").isNotNull() & F.col("sold_at").isNotNull())
    heads = heads.select(F.col("sale_id").cast("long").alias("_sale"), F.coalesce(F.col("client_id").cast("long"), F.lit(-1)).alias("client_id"), micros(F.col("sold_at")).alias("at"), (F.crc32(F.col("sale_id").cast("long").cast("string")) % FOLDS).alias("fold"))
    heads = _looked_up(heads, clients, "client_id", "segment")
    return lines.join(heads.hint("merge"), F.col("sale_id") == F.col("_sale")).drop("_sale")


def return_rates(sale_lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, gap: int = 0) -> DataFrame:
    """sale_id, item_id, vendor_id, n_lines, n_returned and, for item, vendor and client, _n and _rate over the history.

    The rate of all lines is the prior of the rates of kind, nation and segment, and those are the priors of the ids'.
    """
    lines = written(sold_lines(sale_lines, sales, items, vendors, clients), "lines")
    columns = shop_columns()
    found = histories(lines, columns, FOLDS, gap)
    add = functools.partial(with_history, found=found, columns=columns, gap=gap)
    heads = lines.select("client_id", "segment", "at", "fold").distinct()  # a row for each sale: its lines share these three
    heads = functools.reduce(lambda rows, name: add(rows, name=name), ("client", "segment", "all"), heads)
    heads = heads.select(F.col("client_id").alias("_c"), F.col("at").alias("_a"), F.col("fold").alias("_f"), *[f"{n}_{x}" for n in ("client", "segment", "all") for x in "ns"])
    rows = functools.reduce(lambda rows, name: add(rows, name=name), ("item", "kind", "vendor", "nation"), lines)
    rows = rows.join(heads.hint("shuffle_hash"), (F.col("client_id") == F.col("_c")) & (F.col("at") == F.col("_a")) & (F.col("fold") == F.col("_f")))
    of = lambda name, prior: rate(F.col(f"{name}_n"), F.col(f"{name}_s"), prior)
    rows = rows.withColumn("p", of("all", F.lit(500_000).cast("long")))
    out = ["sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned")]
    for name, group in (("item", "kind"), ("vendor", "nation"), ("client", "segment")):
        out += [F.col(f"{name}_n"), of(name, of(group, F.col("p"))).alias(f"{name}_rate")]
    return rows.select(*out)
