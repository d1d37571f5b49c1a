"""Dropping boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import BROADCAST_BYTES, cut, join_sized

_BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_key(line: Column) -> Column:
    """A line without the white space around it, as a hash; null for a blank line."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare != "", F.xxhash64(bare, F.length(bare)))


def boilerplate_lines(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(host, lines, size): each host's line keys that more than ``max_ratio`` of its pages contain, and its pages.

    A line counts once a page.  A line on fewer than ``min_pages`` pages stays.  A host
    can have at most its mean number of lines per page, over the ratio, of such lines.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    keys = pages.select("host", F.explode(F.array_distinct(F.array_compact(F.transform(_lines(F.col("text")), _line_key)))).alias("line"))
    counts = keys.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return frequent.groupBy(counts["host"].alias("host")).agg(F.collect_list("line").alias("lines"), F.first("pages").alias("size"))


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """``docs`` with ``text`` rid of its host's boilerplate lines.

    All columns of ``docs`` stay, and ``lines_total`` and ``lines_dropped`` are added
    (columns with these names are replaced).  Every page stays, if need be with an empty
    text; a null text becomes empty.  A null host is a host of its own; lines are not
    removed where a page has them for itself, but wherever a frequent line occurs.
    """
    frequent = cut(boilerplate_lines(docs, text, host, max_ratio, min_pages))
    size = frequent.agg(F.coalesce(F.sum(F.size("lines") * 8 + 64), F.lit(0))).first()[0]
    # a struct is a key that is not null even where the host is
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(host).alias("host")).alias("_host"))
    side = frequent.select(F.struct("host").alias("_host"), "lines", "size")
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(side), "_host", "left")
    else:  # hosts with many pages are broadcast, pages of the others go to their host
        hosts = rows.groupBy("_host").agg(F.count("*").alias("size"))
        side = cut(hosts.join(side.drop("size"), "_host", "left").select("_host", "lines", "size"))
        widest = side.agg(F.coalesce(F.max(F.size("lines")), F.lit(0))).first()[0]
        joined = join_sized(rows, side, "_host", 8 * max(widest, 0) + 64)
    joined = joined.select("row", "lines", _lines(F.col("row")[text]).alias("all"))
    kept = F.when(F.col("lines").isNull(), F.col("all")).otherwise(F.filter("all", lambda x: ~F.coalesce(F.array_contains("lines", _line_key(x)), F.lit(False))))
    joined = joined.select("row", "all", kept.alias("kept"))
    added = {text: F.array_join("kept", "\n"), "lines_total": F.size("all").cast("long"), "lines_dropped": (F.size("all") - F.size("kept")).cast("long")}
    names = [*docs.columns, *(c for c in ("lines_total", "lines_dropped") if c not in docs.columns)]
    return joined.select(*(added[c].alias(c) if c in added else F.col("row")[c].alias(c) for c in names))
