"""Site-relative line dedup: a line that more than a given share of a host's pages has is
boilerplate of that host and goes.

Only (host, 64-bit line hash) pairs are shuffled, counted map-side first, so neither a hot host
nor a hot line gathers its texts in one task. A host has at most
``mean lines per page / ratio`` boilerplate lines. A wrong drop needs a line whose hash equals
that of one of those few lines of its own host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RATIO = 0.005
MIN_PAGES = 5  # what a share means on hosts of less than MIN_PAGES / RATIO pages; all pages of a host of fewer
BROADCAST_LINES = 200_000  # 1.6 MB of hashes; beyond, host lists are joined by a shuffle


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def _host(c: Column) -> Column:
    return F.concat(F.when(c.isNull(), "0").otherwise("1"), F.coalesce(c, F.lit("")))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host_key, line, pages, host_pages``: lines that over ``ratio`` of the host's pages have, and
    at least ``min_pages`` pages, or all pages of a host of two pages or more that has fewer.
    Blank lines never count, a line counts once a page."""
    host = _host(F.col(host_col)).alias("host_key")
    filled = F.filter(lines_of(F.col(text_col)), lambda x: F.length(F.trim(x)) > 0)
    keys = F.array_distinct(F.transform(filled, line_key))
    pages = docs.select(host).groupBy("host_key").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = docs.select(host, F.explode(keys).alias("line")).groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("pages"))
    least = F.greatest(F.lit(2), F.least(F.lit(min_pages), F.col("host_pages")))
    some = counts.filter(F.col("pages") >= min(2, min_pages)).join(pages, "host_key")
    return some.filter((F.col("pages") >= least) & (F.col("pages") > ratio * F.col("host_pages")))


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` and ``n_dropped`` added, in place of columns that
    have these names.

    Kept lines stay in order and are joined by line feeds; blank lines stay. Null text is an
    empty text of one line, null hosts form one host. Repeated rows are pages of their own and count
    as such, very long texts are read whole, an empty table gives no rows. The number of boilerplate lines is
    counted first: up to ``broadcast_lines`` the lists travel to the texts, beyond it texts
    and lists meet by host in a join that adaptive execution splits where a host is hot.
    """
    found = boilerplate(docs, host_col, text_col, ratio, min_pages).select("host_key", "line")
    found = stored(found, "boilerplate", narrow=True)
    lists = found.groupBy("host_key").agg(F.collect_list("line").alias("__bad")).withColumnRenamed("host_key", "__host")
    # stored, the lists are a plain shuffle, and the join splits a host of many texts
    lists = F.broadcast(lists) if found.count() <= broadcast_lines else stored(lists, "lists")
    out = docs.withColumn("__host", _host(F.col(host_col))).join(lists, "__host", "left")
    lines = lines_of(F.col(text_col))
    bad = F.coalesce(F.col("__bad"), F.array().cast("array<bigint>"))
    # a page's own boilerplate lines are found at once by a hashed set; its lines are looked up in these few
    hits = F.array(F.array_intersect(F.transform(lines, line_key), bad))
    kept = F.transform(hits, lambda hit: F.filter(lines, lambda x: (F.length(F.trim(x)) == 0) | ~F.array_contains(hit, line_key(x))))
    out = out.withColumn("__kept", F.get(kept, 0))
    return (
        out.withColumn("clean_text", F.array_join("__kept", "\n"))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", (F.size(lines) - F.size("__kept")).cast("long"))
        .drop("__host", "__bad", "__kept")
    )
