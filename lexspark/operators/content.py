"""The content tree as flat rows keyed by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reference import GRID_PREFIXES, ROUTE_WIDGETS
from ..functions.text import title


def content_tree(files: DataFrame) -> DataFrame:
    """route, parent, kind (index, book_page, page), page_number, title, ext, text; hidden files are left out."""
    rows = files.where(~F.col("file").rlike(r"(^|/)\.")).where(F.col("file").rlike(r"\.(md|txt)$"))
    name = F.regexp_extract("file", r"([^/]*)\.(?:md|txt)$", 1)
    parent = F.regexp_replace(F.regexp_extract("file", r"^(.*?)[^/]*$", 1), "/$", "")
    rows = rows.withColumn("name", name).withColumn("parent", parent).withColumn("ext", F.regexp_extract("file", r"(\.[a-z]+)$", 1))
    book = F.col("name").rlike("^[0-9]+$") & (F.col("ext") == ".txt")
    kind = F.when(F.col("name") == "index", "index").when(book, "book_page").otherwise("page")
    route = F.when(kind == "page", F.concat_ws("/", F.nullif("parent", F.lit("")), "name")).otherwise(F.col("parent"))
    shown = F.when(kind == "page", F.col("name")).otherwise(F.regexp_extract("parent", r"([^/]*)$", 1))
    return rows.select(route.alias("route"), "parent", kind.alias("kind"), F.when(book, F.col("name").cast("int")).alias("page_number"), title(shown).alias("title"), "ext", "text")


def book_pages(tree: DataFrame) -> DataFrame:
    """route and its pages in numeric order."""
    pages = tree.where("kind = 'book_page'").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    return pages.select("route", F.transform("p", lambda x: x["text"]).alias("pages"))


def directories(tree: DataFrame) -> DataFrame:
    """parent and its contents (name, is_dir, href), in the order of a depth-first walk that ends in the root."""
    leaf = tree.where("kind = 'page'").select("parent", F.regexp_extract("route", r"([^/]*)$", 1).alias("name"), F.lit(False).alias("is_dir"), F.col("route").alias("href"))
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("parent", "/"))), lambda i: F.array_join(F.slice(F.split("parent", "/"), F.lit(1), i), "/"))
    every = tree.where("parent <> ''").select(F.explode(steps).alias("href")).distinct()
    inner = every.select(F.regexp_replace(F.regexp_extract("href", r"^(.*?)[^/]*$", 1), "/$", "").alias("parent"), F.regexp_extract("href", r"([^/]*)$", 1).alias("name"), F.lit(True).alias("is_dir"), "href")
    each = leaf.unionByName(inner).groupBy("parent").agg(F.array_sort(F.collect_set(F.struct("name", "is_dir", "href"))).alias("contents"))
    return each.orderBy(F.concat("parent", F.lit("/￿")))


def route_features(routes: DataFrame, column: str = "route") -> DataFrame:
    """route, widget (null if none), view."""
    widget = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUTE_WIDGETS.items() for x in kv]), F.col(column))
    grid = F.lit(False)
    for p in GRID_PREFIXES:
        grid = grid | F.col(column).startswith(p)
    return routes.select(F.col(column).alias("route"), widget.alias("widget"), F.when(grid, "grid").otherwise("list").alias("view"))
