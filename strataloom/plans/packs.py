"""Queries that write what Spark derives from the tables in a pack's formats and read it back, with SQL twins on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.lineage import shared_folder
from strataloom.operators import content as C
from strataloom.operators import search as Q
from strataloom.operators import tables as B
from strataloom.operators.corpus import corpus
from strataloom.plans.tables import SQL_CORPUS, table
from strataloom.sources import readers as R
from strataloom.sources import warc as W
from strataloom.sources import writers as K
from strataloom.streaming import runs
from strataloom.streaming import stateful as S


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def warc_pages(spark, sf_dir):
    """Pages written as WARC members and read back: only addresses, sizes and digests are made."""
    folder = _folder(spark, "warc")
    W.write_warc(table(spark, sf_dir, "pages"), folder)
    return W.read_warc(spark, folder, ["target_uri", "length", "payload_digest", "error"])


def record_lines(spark, sf_dir):
    """Records written as lines of JSON and read back in the record's fields."""
    folder = _folder(spark, "records")
    rows = corpus(table(spark, sf_dir, "documents"))
    K.write_records(rows.select("document_id", "url", "title", "content", "content_hash", F.col("source").alias("source_type")), folder)
    read = R.read_records(spark, folder)
    return read.select("document_id", "url", "title", F.sha2("content", 256).alias("content_sha256"), (F.sha2("content", 256) == F.col("content_hash")).alias("same"), "source_type")


def delimited_profile(spark, sf_dir):
    """Line items written as delimited text and read back: values, nulls and distinct values of each column."""
    folder = _folder(spark, "delimited")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.nullif("l_linestatus", F.lit("F")).alias("l_linestatus"))
    K.write_table(rows, folder, "csv")
    read = R.read_delimited(spark, folder)
    counts = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(F.col(c)).alias("distinct_values")) for c in read.columns]
    return read.agg(F.array(*counts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def url_list(spark, sf_dir):
    """Addresses of pages among other lines of a text file."""
    folder = _folder(spark, "urls")
    table(spark, sf_dir, "pages").select(F.explode(F.array(F.concat(F.lit("# page "), "page_id"), F.concat(F.lit("  "), "url"), F.lit(""))).alias("value")).write.text(folder)
    return R.read_urls(spark, folder)


def _xml(text):
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def feed_entries(spark, sf_dir):
    """Documents as items of a feed of their language, one item a line of it, and parsed again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    item = F.concat(F.lit("<item><title>Document "), "doc_id", F.lit("</title><link>https://a.example/"), "lang", F.lit("/"), "doc_id", F.lit("</link><guid>g"), "doc_id", F.lit("</guid><description><![CDATA["), "n", F.lit(" characters]]></description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>"))
    feeds = docs.select("lang", F.concat(F.lit("<rss><channel><title>feed</title>"), item, F.lit("</channel></rss>")).alias("xml"))
    return R.parse_feed(feeds)


def sitemap_urls(spark, sf_dir):
    """A sitemap of each host's pages, parsed again."""
    pages = table(spark, sf_dir, "pages").where("url is not null").select("page_id", "url")
    maps = pages.select("page_id", F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url></urlset>")).alias("xml"))
    return R.parse_sitemap(maps)


def transcript_cues(spark, sf_dir):
    """Conversations' turns as cues of a transcript, ten seconds each, and parsed again."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    clock = lambda s: F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(s / 60 % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(".500"))
    start = F.col("turn") * 10
    cue = F.concat(clock(start), F.lit(" --> "), clock(start + 10), F.lit("\n<v "), F.initcap("role"), F.lit(">says "), "n", F.lit(" characters</v>"))
    return R.parse_transcript(turns.select("conv_id", "turn", F.concat(F.lit("WEBVTT\n\n"), cue).alias("text")))


def main_content(spark, sf_dir):
    """Main content of pages, by selectors and scores."""
    rows = C.main_content(table(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("page_id", "content_selector", "content_score", F.length("content_text").cast("long").alias("n_chars"), F.sha2("content_text", 256).alias("text_sha256"))


def best_extractions(spark, sf_dir):
    """The best Markdown of each page among the main content's and the dense blocks'."""
    rows = C.extract_best(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "extraction.name", "extraction.score", "extraction.candidates", F.sha2("extraction.markdown", 256).alias("sha256"))


def orders_as_of(spark, sf_dir):
    """The last event of a customer's number at or before each order, as a join on time."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("at"))
    events = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("who"), F.col("l_shipdate").alias("at"), "l_extendedprice")
    last = events.groupBy("who", "at").agg(F.max("l_extendedprice").alias("price"))
    return B.as_of(orders, last, "who", "at", "price").select("o_orderkey", "price_as_of")


def stratified_documents(spark, sf_dir):
    """Three documents of each language, drawn by a hash of their keys."""
    return B.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")), "lang", "doc_id", 3).select("lang", "doc_id")


def first_of_each_user(spark, sf_dir):
    """Each user's first event in time, the smaller number first of several."""
    return K.first_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])


def posting_lists(spark, sf_dir):
    """How many documents hold each of their words, and how often."""
    rows = Q.postings(corpus(table(spark, sf_dir, "documents")))
    return rows.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


def windowed_event_stream(spark, sf_dir):
    """Events of each type in windows of a day, counted by a stream that goes over the table's files."""
    own = runs.stateful_session(spark)
    stream = runs.table_stream(own, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _folder(spark, "windows")
    runs.run_available(S.windowed_counts(stream, "ts", "event_type", "1 day", "0 seconds"), folder)
    newest = runs.put_out(spark, folder).groupBy("start", "end", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return newest.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


QUERIES = [warc_pages, record_lines, delimited_profile, url_list, feed_entries, sitemap_urls, transcript_cues, main_content, best_extractions, orders_as_of, stratified_documents, first_of_each_user, posting_lists, windowed_event_stream]

SQL = {
    "warc_pages": "SELECT coalesce(url, '') AS target_uri, strlen(coalesce(html, ''))::BIGINT AS length, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest, NULL::VARCHAR AS error FROM pages",
    "record_lines": f"""WITH {SQL_CORPUS} SELECT 'doc_' || left(sha256(url || chr(31) || content_hash), 24) AS document_id, url, title, content_hash AS content_sha256, true AS same, source AS source_type FROM corpus""",
    "delimited_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({v}) AS n, count(*) FILTER ({v} IS NULL) AS nulls, count(DISTINCT {v}) AS distinct_values FROM lineitem"
        for c, v in {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_returnflag": "l_returnflag", "l_linestatus": "nullif(l_linestatus, 'F')"}.items()
    ),
    "url_list": "SELECT trim(url, ' ') AS url FROM pages WHERE regexp_matches(trim(url, ' '), '(?i)^https?://')",
    "feed_entries": """SELECT coalesce(lang, '') AS lang, 'g' || doc_id AS id, 'https://a.example/' || coalesce(lang, '') || '/' || doc_id AS url, 'Document ' || doc_id AS title,
      length(coalesce(text, '')) || ' characters' AS summary, 'Mon, 01 Jan 2024 00:00:00 GMT' AS published FROM documents""",
    "sitemap_urls": "SELECT page_id, false AS is_index, url AS loc FROM pages WHERE url IS NOT NULL",
    "transcript_cues": """SELECT conv_id, turn, 0 AS index, turn * 10 + 0.5::DOUBLE AS start, turn * 10 + 10.5::DOUBLE AS "end", upper(left(role, 1)) || substring(role, 2) AS speaker,
      'says ' || length(coalesce(text, '')) || ' characters' AS text FROM conversations""",
    "orders_as_of": """WITH e AS (SELECT l_suppkey AS who, l_shipdate AS t, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
      SELECT o_orderkey, e.price AS price_as_of FROM orders ASOF LEFT JOIN e ON o_custkey = e.who AND o_orderdate >= e.t""",
    "stratified_documents": """SELECT lang, doc_id FROM (SELECT coalesce(lang, '') AS lang, doc_id, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY md5('0:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 3""",
    "first_of_each_user": "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL) WHERE n = 1 UNION ALL SELECT user_id, event_id, ts FROM events WHERE user_id IS NULL",
    "posting_lists": f"""WITH {SQL_CORPUS}, w AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(content, '{T.KEYWORD}'), lambda x: lower(x))) AS term FROM corpus)
      SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM w GROUP BY 1""",
    "windowed_event_stream": "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1, 2",
}
