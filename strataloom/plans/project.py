"""Queries that assemble a project's records: merging, batches, windows and mentions of entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import html as H
from strataloom.functions import text as T
from strataloom.functions import urls as U
from strataloom.operators import batches as B
from strataloom.operators import graph as G
from strataloom.operators import mentions as M
from strataloom.operators.corpus import corpus
from strataloom.operators.merging import merge_records
from strataloom.plans.tables import table

#: The host that each project source names as its own.
PROJECT_HOSTS = {"src0": "src0.example", "src1": "src1.example"}


def project_records(spark, sf_dir):
    """Documents as records of project sources: addresses by title, so that versions of a page share them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("content"))
    title = F.left(F.split_part("content", F.lit("\n"), F.lit(1)), F.lit(60))
    rows = rows.withColumn("title", T.clean_title(title))
    host = F.concat("source", F.lit(".example"))
    url = F.concat(F.lit("HTTPS://"), host, F.lit("/docs/"), T.slug(F.col("title")), F.lit("/#top"))
    return rows.select("*", url.alias("url"), F.concat(F.lit("https://mirror.example/"), T.slug(F.left("content", F.lit(200)))).alias("canonical_url"), T.content_hash(F.col("content")).alias("content_hash"))


def project_keys(source="source"):
    """The keys by which records are the same, in the order in which they are looked up."""
    canonical, url = (U.canonical(F.trim(c)) for c in ("canonical_url", "url"))
    print_ = T.content_fingerprint(F.col("content"))
    key = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}:"), value))
    fingerprint = F.when((F.col(source) != "") & (F.col("title") != "") & (print_ != ""), F.concat_ws(":", F.lit("fingerprint"), source, F.lower("title"), print_))
    return F.array(key("canonical", canonical), key("url", url), key("hash", F.col("content_hash")), fingerprint)


def project_quality(source="source"):
    """How many addresses are on the source's own host, the content's length, the title's."""
    hosts = F.create_map(*[F.lit(x) for pair in PROJECT_HOSTS.items() for x in pair])
    own = F.coalesce(hosts[F.col(source)], F.lit(""))
    on_own = lambda c: ((own != "") & (U.host(F.trim(c)) == own)).cast("long")
    return F.array(on_own("url") + on_own("canonical_url"), F.length("content").cast("long"), F.length("title").cast("long"))


def project_dedup(spark, sf_dir):
    """Documents merged in the order of their keys by canonical address, address, hash and fingerprint."""
    merged = merge_records(project_records(spark, sf_dir), "doc_id", project_keys(), project_quality())
    return merged.select(F.col("slot").alias("first_doc_id"), F.col("winner").alias("doc_id"))


def embedding_batches(spark, sf_dir):
    """Documents of each source in batches for an embedding service."""
    rows = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", B.estimated_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return B.greedy_batches(rows, "source", ["doc_id"], F.col("tokens"))


def overlap_windows(spark, sf_dir):
    rows = B.overlapping_windows(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "chunk_index", "heading", "tokens", F.sha2("content", 256).alias("sha256"))


def _entities(spark, sf_dir):
    totals = G.entity_totals(corpus(table(spark, sf_dir, "documents")))
    name = F.concat(F.lit("entity:"), F.col("type"), F.lit(":"), F.col("normalized"))
    return totals.select(name.alias("entity_id"), F.array("value", "normalized").alias("candidates"))


def chunk_mentions(spark, sf_dir):
    """Documents that hold an entity of the corpus anywhere in their text, whatever its case."""
    return M.entity_mentions(corpus(table(spark, sf_dir, "documents")), _entities(spark, sf_dir))


def entity_relations(spark, sf_dir):
    """Pairs of entities in one sentence, by what the sentence says of them."""
    return M.sentence_relations(corpus(table(spark, sf_dir, "documents")), _entities(spark, sf_dir))


def page_title_mentions(spark, sf_dir):
    """Pages whose html holds the title of another page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    titles = pages.select("page_id", H.element_text(F.col("html"), "title").alias("title"))
    found = M.name_matches(pages, titles.select(F.col("title").alias("name")), "page_id", "html")
    return found.groupBy("page_id").agg(F.count("*").alias("titles"))


QUERIES = [project_dedup, embedding_batches, overlap_windows, chunk_mentions, entity_relations, page_title_mentions]

SQL = {
    "embedding_batches": rf"""WITH RECURSIVE t AS (SELECT coalesce(source, '') AS source, doc_id, ceil((length(coalesce(text, '')) + len(regexp_extract_all(coalesce(text, ''), '[\x{{10000}}-\x{{10FFFF}}]'))) / 4)::BIGINT AS tokens FROM documents),
      p AS (SELECT *, row_number() OVER w - 1 AS place, sum(tokens) OVER w AS total FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
      n AS (SELECT a.source, a.place, min(b.place) AS follow FROM p a JOIN p b ON a.source = b.source AND b.place > a.place AND b.place <= a.place + {B.BATCH_ROWS}
        AND (b.total - a.total + a.tokens > {B.BATCH_TOKENS} OR b.place = a.place + {B.BATCH_ROWS}) GROUP BY 1, 2),
      s AS (SELECT DISTINCT source, 0::BIGINT AS place, 0::BIGINT AS batch FROM t UNION ALL SELECT n.source, n.follow, s.batch + 1 FROM s JOIN n ON s.source = n.source AND s.place = n.place)
      SELECT p.source, doc_id, tokens, s.batch FROM p ASOF JOIN s ON p.source = s.source AND p.place >= s.place""",
}
