"""Line deduplication by how many of its host's pages hold a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint, named, packed, unpacked

#: Digests of boilerplate lines of all hosts up to which they are broadcast (some 6 MB); beyond it hosts are joined.
MOST_BROADCAST = 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.md5(line.cast("binary"))


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """(host, lines): for each host that has any, the digests of the lines on more than ``max_ratio`` of its pages.

    A page counts once for a line however often it repeats it. Lines on fewer than ``min_pages`` pages and blank ones
    are never boilerplate. Counts are summed before they are shuffled, by host and digest, so a hot host is spread
    over all tasks. A host's list is at most its mean number of distinct lines on a page divided by ``max_ratio``.
    """
    pages = docs.select(named(docs, host_col).cast("string").alias("host"), named(docs, text_col).cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.length(F.trim(x)) > 0), _digest))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    over = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > max_ratio * F.col("pages"))
    return over.groupBy("c.host").agg(F.collect_list("line").alias("lines"))


def drop_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = 0.02, min_pages: int = 5, most_broadcast: int = MOST_BROADCAST, counts: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text and, with ``counts``, the columns _n_lines and _n_dropped after its own.

    Columns of ``docs`` that have these two names give way to them.

    Every row stays, one whose lines are all dropped with an empty text; null texts stay null with no lines. A null host
    is a host of its own. Lines end at a line feed and are compared as they are. Repeated rows count as pages each. The
    lists of all hosts are broadcast if they are few by count; otherwise they are joined by host, where adaptive
    execution splits a hot host's texts. An empty table gives no rows.
    """
    lists = checkpoint(boilerplate(docs, text_col, host_col, max_ratio, min_pages))
    found = lists.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"]
    lists = F.broadcast(lists) if found <= most_broadcast else lists
    rows = docs.select(packed(docs), named(docs, host_col).cast("string").alias("own_host"), _lines(named(docs, text_col).cast("string")).alias("own"))
    met = rows.join(lists, F.col("own_host").eqNullSafe(F.col("host")), "left")
    met = met.withColumn("out", F.when(F.col("lines").isNotNull(), F.array_intersect(F.transform("own", _digest), "lines")))
    some = F.coalesce(F.size("out"), F.lit(0)) > 0
    met = met.withColumn("stay", F.when(some, F.filter("own", lambda x: ~F.array_contains("out", _digest(x)))).otherwise(F.col("own")))
    text = F.when(some, F.array_join("stay", "\n")).otherwise(F.col("row").getField(text_col).cast("string")).alias(text_col)
    added = {
        "_n_lines": F.when(F.col("own").isNull(), 0).otherwise(F.coalesce(F.size("own"), F.lit(0))),
        "_n_dropped": F.when(some, F.size("own") - F.size("stay")).otherwise(0),
    } if counts else {}
    columns = [text if c == text_col else x for c, x in zip(docs.columns, unpacked(docs.columns), strict=True) if c not in added]
    return met.select(*columns, *[x.cast("long").alias(name) for name, x in added.items()])
