"""Entities of a corpus and the graph of sources, documents and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.lineage import cut


def entities(records: DataFrame) -> DataFrame:
    """(doc_id, source, type, value): every match of the entity patterns, in order."""

    def matches(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    kinds = F.flatten(F.array(*[matches(k, p) for k, p in T.ENTITIES.items()]))
    return records.select("doc_id", "source", F.posexplode(kinds).alias("pos", "e")).select("doc_id", "source", "pos", "e.type", "e.value").where(F.length("value") >= 3)


def normalized_entity(kind: Column, value: Column) -> Column:
    folded = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    return F.when(kind == "version", F.regexp_replace(folded, r"^(?:version\s*|v)", "")).otherwise(folded)


def entity_totals(records: DataFrame) -> DataFrame:
    """(type, normalized, mentions, documents, first value) of every valid entity."""
    found = entities(records).withColumn("normalized", normalized_entity(F.col("type"), F.col("value")))
    bare = F.upper("value").isin("API", "SDK", "MCP", "RAG", "LLM", "CLI")
    valid = found.where(~((F.col("type") == "version") & (F.length("value") > 24)) & ~((F.col("type") == "technical_term") & bare))
    return valid.groupBy("type", "normalized").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"), F.min_by("value", F.struct("doc_id", "pos")).alias("value"))


def edges(records: DataFrame) -> DataFrame:
    """(kind, from_id, to_id) between sources, documents and entities, without repeats."""
    own = records.select(F.lit("contains_document").alias("kind"), F.concat(F.lit("source:"), F.col("source")).alias("from_id"), F.concat(F.lit("document:"), F.col("doc_id")).alias("to_id"))
    found = entities(records)
    name = F.concat(F.lit("entity:"), F.col("type"), F.lit(":"), normalized_entity(F.col("type"), F.col("value")))
    mentions = found.select(F.lit("mentions").alias("kind"), F.concat(F.lit("document:"), F.col("doc_id")).alias("from_id"), name.alias("to_id"))
    return own.unionByName(mentions).distinct()


def cooccurrences(records: DataFrame) -> DataFrame:
    """(left_id, right_id, documents): unordered pairs of entities that documents share.

    Pairs are made within a document from its own distinct entities, a list bounded by
    the document, so nothing is joined.
    """
    name = F.concat(F.lit("entity:"), F.col("type"), F.lit(":"), normalized_entity(F.col("type"), F.col("value")))
    lists = entities(records).groupBy("doc_id").agg(F.array_sort(F.collect_set(name)).alias("names"))
    pairs = F.flatten(F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(a.alias("left_id"), b.alias("right_id")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.left_id", "p.right_id").agg(F.count("*").alias("documents"))


def neighbours(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, kind, neighbour): the other ends of the edges at ``ids``, whichever end they are.

    Two equi-joins, since one join on either end would compare everything with everything.
    """
    out = graph.join(ids, graph["from_id"] == ids["id"]).select("id", "kind", F.col("to_id").alias("neighbour"))
    back = graph.join(ids, graph["to_id"] == ids["id"]).select("id", "kind", F.col("from_id").alias("neighbour"))
    return out.unionByName(back)


def closure(links: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): breadth-first from ``roots`` (node) over ``links`` (from_id, to_id).

    Each step joins the frontier with the links and drops what was seen; it stops when
    nothing new is found.
    """
    seen = cut(roots.select("node", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(links, frontier["node"] == links["from_id"]).select(F.col("to_id").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
