"""Boilerplate lines by their frequency within a site, with DataFrame functions only.

For every site, the pages that hold a line are divided by the site's pages; lines above the ratio are dropped from the site's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import broadcast_if_small, is_small, materialize

RATIO = 0.1
LEAST_PAGES = 3  # a line on one or two pages repeats no more than copies and quotes do, however small the site
LISTS = 500_000  # sites whose lists may go to all tasks, as far as their bytes allow
PAGES_PER_TASK = 10_000  # pages of a site that meet its list in one group, about


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def visible_lines(html: Column) -> Column:
    """Markup as line breaks."""
    return F.regexp_replace(html, "<[^>]*>", "\n")


def _hashes(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda l: F.trim(l) != ""), lambda l: F.xxhash64(F.trim(l)))


def _works(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct rows with ``work``, the class of the text or, where it is in none, the text itself."""
    known = classes.select(F.col("text_hash").alias("hash"), "class")
    return rows.distinct().join(known, "hash", "left").withColumn("work", F.struct("class", F.when(F.col("class").isNull(), F.col("hash")).alias("hash")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, classes: DataFrame | None = None) -> DataFrame:
    """(site, line hash) of pages (site, text) for the lines on more than ``ratio`` of a site's pages.

    Lines are counted once per page and combine before the shuffle, so a line on every page costs a task one row. With
    ``classes`` (text_hash, class; one row per text_hash) the copies of a text and the texts of a class count as one page, of
    the lines and of the site.
    """
    every = F.explode(F.array_distinct(_hashes(F.split("text", "\n")))).alias("line")
    if classes is None:
        lines, number, whole = pages.select("site", every), F.count(F.lit(1)), pages
    else:
        hashed = pages.select("site", F.xxhash64("text").alias("hash"), "text")
        lines, number = _works(hashed.select("site", "hash", every), classes), F.count_distinct("work")
        whole = _works(hashed.select("site", "hash"), classes)
    holding = lines.groupBy("site", "line").agg(number.alias("holding")).where(F.col("holding") >= least_pages)
    totals = whole.groupBy("site").agg(number.alias("total"))
    return holding.join(totals, "site").where(F.col("holding") > ratio * F.col("total")).select("site", "line")


def drop_site_lines(
    pages: DataFrame, site: Column | str = "source", text_column: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
    classes: DataFrame | None = None,
) -> DataFrame:
    """The input rows with ``text_column`` without its site's boilerplate, and n_lines, n_dropped (lines that are not blank).

    Lines are compared without blanks at their ends, by a 64-bit hash. A text that loses nothing stays as it is; one that loses
    all its lines becomes empty. A null text stays null with no lines, but counts as a page of its site. Rows without a site are
    one site. Repeated rows count as pages of their own, unless ``classes`` makes them one (see ``boilerplate``). Other columns stay as
    they are, whatever their names, before the two new ones; an empty table stays empty.

    A site's list is short: no more lines than a page's mean number of lines divided by the ratio. While all lists are small they go to
    the pages, which are not shuffled. Else pages meet them by site and a salt; a site has a salt for every PAGES_PER_TASK pages.
    """
    key = F.coalesce(F.col(site) if isinstance(site, str) else site, F.lit(""))
    rows = pages.select(key.alias("site"), F.col(f"`{text_column}`").alias("text"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in pages.columns if c != text_column]).alias("row"))
    found = boilerplate(rows.select("site", "text"), ratio, least_pages, classes)
    lists = materialize(found.groupBy("site").agg(F.collect_set("line").alias("list")))
    if is_small(lists, LISTS):
        joined = rows.join(F.broadcast(lists), "site", "left")
    else:
        large = rows.groupBy("site").agg(F.ceil(F.count(F.lit(1)) / PAGES_PER_TASK).alias("salts")).where("salts > 1")
        large = broadcast_if_small(materialize(large))
        salts = F.coalesce("salts", F.lit(1))
        salted = lists.join(large, "site", "left").select("site", "list", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        salt = F.floor(F.rand(7) * salts)  # any draw gives the same result
        joined = rows.join(large, "site", "left").select("site", "text", "row", salt.alias("salt")).join(salted, ["site", "salt"], "left")
    lines = F.split("text", "\n")
    hits = F.array_intersect(_hashes(lines), F.coalesce("list", F.array().cast("array<bigint>")))
    marked = joined.select("text", "row", hits.alias("hits"))
    gone = lambda l: F.array_contains("hits", F.xxhash64(F.trim(l))) & (F.trim(l) != "")
    some = F.size("hits") > 0
    kept = F.when(some, F.array_join(F.filter(lines, lambda l: ~gone(l)), "\n")).otherwise(F.col("text"))
    n_lines = F.coalesce(F.size(F.filter(lines, lambda l: F.trim(l) != "")), F.lit(0)).cast("long")
    dropped = F.when(some, F.size(F.filter(lines, gone))).otherwise(0).cast("long")
    others = [kept.alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in pages.columns]
    return marked.select(*others, F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), dropped.alias("n_dropped"))
