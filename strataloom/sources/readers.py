"""Readers of corpora: line-delimited JSON, delimited tables, feeds, transcripts and url lists.

Each gives a lazy DataFrame; files are listed and split by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a document record that every operator here reads.
RECORD = "document_id string, url string, title string, content string, content_hash string, source_type string"


def read_records(spark: SparkSession, path: str, schema: str = RECORD, strict: bool = True) -> DataFrame:
    """Records of line-delimited JSON; blank lines are skipped.

    With ``strict`` a malformed line fails the job, else it is left out; lines that hold
    no object are left out.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").where(F.trim("value").startswith("{") | F.lit(strict))
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return lines.select(F.from_json("value", schema, mode).alias("r")).where("r is not null").select("r.*")


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A table of texts with the names of its first line; quoted fields may span lines."""
    return spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"').csv(path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url): the urls of a text file, one a line; comments and other lines are left out."""
    line = F.trim("value")
    return spark.read.text(path).where(line.rlike("(?i)^https?://")).select(line.alias("url"))


def _tag(xml: Column, name: str) -> Column:
    inner = F.regexp_extract(xml, rf"(?is)<{name}(?:\s[^>]*)?>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{name}>", 1)
    return F.nullif(F.trim(inner), F.lit(""))


def parse_feed(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per item or entry of RSS and Atom texts: id, url, title, summary, published."""
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), F.lit(1))
    rows = feeds.select(*[c for c in feeds.columns if c != xml], F.explode(items).alias("_item"))
    item = F.col("_item")
    href = F.nullif(F.regexp_extract(item, r"""(?is)<link[^>]*\shref=["']([^"']+)""", 1), F.lit(""))
    url = F.coalesce(_tag(item, "link"), href)
    return rows.select(
        *rows.drop("_item").columns,
        F.coalesce(_tag(item, "guid"), _tag(item, "id"), url).alias("id"),
        url.alias("url"),
        _tag(item, "title").alias("title"),
        F.coalesce(_tag(item, "description"), _tag(item, "summary"), _tag(item, "content")).alias("summary"),
        F.coalesce(_tag(item, "pubDate"), _tag(item, "published"), _tag(item, "updated")).alias("published"),
    )


def parse_sitemap(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per place of sitemap texts: loc, and whether it is a further map."""
    locs = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)"), F.lit(1))
    index = F.col(xml).rlike(r"(?i)<sitemapindex[\s>]")
    return maps.select(*[c for c in maps.columns if c != xml], index.alias("is_index"), F.explode(locs).alias("loc"))


def _seconds(stamp: Column) -> Column:
    parts = F.split(F.regexp_replace(stamp, ",", "."), ":")
    back = F.reverse(parts)
    at = lambda i: F.coalesce(F.get(back, F.lit(i)).cast("double"), F.lit(0.0))
    return at(0) + 60 * at(1) + 3600 * at(2)


def parse_transcript(files: DataFrame, text: str = "text") -> DataFrame:
    """A row per cue of VTT and SRT texts: index, start and end in seconds, speaker, text."""
    blocks = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n[ \t]*\n")
    cue = r"(?s)((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})[^\n]*\n(.*)"
    cues = F.filter(blocks, lambda b: b.rlike(cue))
    rows = files.select(*[c for c in files.columns if c != text], F.posexplode(cues).alias("index", "_cue"))
    said = F.regexp_replace(F.regexp_extract("_cue", cue, 3), r"</?[a-zA-Z][^>]*>", "")
    said = F.trim(F.regexp_replace(said, r"\s+", " "))
    voice = F.nullif(F.regexp_extract("_cue", r"<v\s+([^>]+)>", 1), F.lit(""))
    named = F.nullif(F.regexp_extract(said, r"^([A-Z][\w .'-]{0,40}):\s", 1), F.lit(""))
    return rows.select(
        *rows.drop("_cue", "index").columns,
        "index",
        _seconds(F.regexp_extract("_cue", cue, 1)).alias("start"),
        _seconds(F.regexp_extract("_cue", cue, 2)).alias("end"),
        F.coalesce(voice, named).alias("speaker"),
        F.when(voice.isNull() & named.isNotNull(), F.regexp_replace(said, r"^[A-Z][\w .'-]{0,40}:\s+", "")).otherwise(said).alias("text"),
    )
