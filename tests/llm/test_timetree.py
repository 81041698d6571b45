"""Operator 12: the tree against sums over all pairs, and the query against its SQL."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexspark.llm import timetree as T
from lexspark.llm.queries import ORACLES, op12_time_tree
from tests.oracle import connect, difference


def test_query_against_sql(spark, sf):
    assert difference(op12_time_tree(spark, sf), ORACLES["op12_time_tree"], connect(sf)) is None


def test_tree_against_all_pairs(spark):
    draw = random.Random(1)
    # a key with half of all lines, ties, fractions of a second, and lines on both sides of 1970
    lines = [(draw.choice([0, 0, 0, 1, 2]), draw.choice(["a", "b"]), draw.randrange(-40, 400) * 250_000 * draw.choice([1, 1, 40_000]), draw.randrange(3), draw.randrange(1, 4)) for _ in range(400)]
    lines = [(k, w, at, f, n, draw.randrange(n + 1)) for k, w, at, f, n in lines]
    frame = spark.createDataFrame(lines, "k long, w string, at long, fold long, n long, s long").withColumn("id", F.monotonically_increasing_id())
    for gap in (0, 1, 7_000_000):
        for leaf in (1, 64, 1 << 18):
            columns = [T.Encoded("k", F.col("k"), None, leaf), T.Encoded("w", F.lit(0), F.col("w"), 3)]
            found = T.histories(frame, columns, 3, gap)
            rows = T.with_history(T.with_history(frame, found, columns, "k", gap), found, columns, "w", gap).collect()
            assert len(rows) == len(lines)
            for r in rows[:: 7 if leaf > 1 else 1]:
                for name, n, s in (("k", r.k_n, r.k_s), ("w", r.w_n, r.w_s)):
                    held = [x for x in lines if x[3] != r.fold and x[2] < r.at - gap and x[0 if name == "k" else 1] == r[name]]
                    assert (n, s) == (sum(x[4] for x in held), sum(x[5] for x in held))


def test_null_values_and_leaves_over_several_batches(spark):
    draw = random.Random(2)
    lines = [(draw.choice([None, 0, 7]), draw.randrange(60) * 500_000, draw.randrange(3), draw.randrange(1, 4)) for _ in range(300)]
    frame = spark.createDataFrame([(*x, draw.randrange(x[3] + 1)) for x in lines], "k long, at long, fold long, n long, s long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, leaf in ((1, 4), (2, 1 << 18), (7, 8), (1000, 4)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            columns = [T.Encoded("k", F.col("k"), None, leaf), T.Encoded("all", F.lit(0), None, leaf)]
            found = T.histories(frame, columns, 3)
            rows = T.with_history(T.with_history(frame, found, columns, "k"), found, columns, "all").collect()
            assert len(rows) == len(lines)
            for r in rows:
                held = [x for x in lines if x[2] != r.fold and x[1] < r.at]
                assert (r.k_n, r.all_n) == (sum(x[3] for x in held if x[0] == r.k), sum(x[3] for x in held))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_shop_cases(spark):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    lines = [(1, 5, 9, "returned"), (1, 5, 9, "returned"), (1, None, 9, None), (2, 5, None, "kept"), (3, 5, 9, "kept"), (None, 5, 9, "kept"), (4, 5, 9, "kept"), (99, 5, 9, "kept"), (6, -1, 9, "kept"), (7, 8, 9, "kept")]
    sales = [(1, 1, t(0)), (2, None, t(1)), (3, 2, t(2)), (4, 1, None), (6, 1, t(2)), (7, -1, t(3))]
    items, vendors, clients = [(5, "x"), (8, None)], [(9, None)], [(1, "s"), (1, None), (None, "s")]
    make = lambda rows, schema: spark.createDataFrame([(*r, 0) for r in rows], schema + ", n long")
    tables = [make(lines, "sale_id long, item_id long, vendor_id long, flag string"), make(sales, "sale_id long, client_id long, sold_at timestamp_ntz"), make(items, "item_id long, kind string"), make(vendors, "vendor_id long, nation_id int"), make(clients, "client_id long, segment string")]
    rows = {(r.sale_id, r.item_id, r.vendor_id): r for r in T.return_rates(*tables).collect()}
    assert set(rows) == {(1, 5, 9), (1, -1, 9), (2, 5, None), (3, 5, 9), (6, -1, 9), (7, 8, 9)}
    assert (rows[1, 5, 9].n_lines, rows[1, 5, 9].n_returned, rows[1, 5, 9].item_n, rows[1, 5, 9].item_rate) == (2, 2, 0, 500_000)
    import zlib

    fold = lambda sale: zlib.crc32(str(sale).encode()) % 5
    at = {s: a for s, _, a in sales if a}
    client = {s: -1 if c is None else c for s, c, _ in sales}
    kind, segment = {5: "x"}, {1: "s"}
    held = [(s, -1 if i is None else i, v, f == "returned") for s, i, v, f in lines if s in at]

    def rate(now, same, prior):
        history = [h for h in held if fold(h[0]) != fold(now) and at[h[0]] < at[now] and same(h)]
        n, s = len(history), sum(h[3] for h in history)
        return n, prior if n < 1 else (1_000_000 * s + 50 * prior) // (n + 50)

    for (sale, item, vendor), r in rows.items():
        p = rate(sale, lambda h: True, 500_000)[1]
        for got, same, group in (
            ((r.item_n, r.item_rate), lambda h: h[1] == item, lambda h: kind.get(h[1]) == kind.get(item)), ((r.vendor_n, r.vendor_rate), lambda h: h[2] == vendor, lambda h: True),
            ((r.client_n, r.client_rate), lambda h: client[h[0]] == client[sale], lambda h: segment.get(client[h[0]]) == segment.get(client[sale])),
        ):
            assert got == rate(sale, same, rate(sale, group, p)[1])
    assert T.return_rates(*[x.limit(0) for x in tables]).count() == 0


def test_no_zone_shifts(spark):
    rows = spark.createDataFrame([(datetime(2024, 3, 31, 2, 30, 0, 5),), (datetime(1969, 12, 31, 23, 59, 59, 999_999),)], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert [r.m for r in rows.select(T.micros(F.col("t")).alias("m")).collect()] == [1711852200000005, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
