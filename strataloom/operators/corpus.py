"""Versioned corpora: records, identities, duplicates, citations, manifests and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.functions import text as T
from strataloom.functions import urls as U
from strataloom.lineage import cut
from strataloom.operators.joins import join_split
from strataloom.operators.ordered import running_sums


def corpus(documents: DataFrame) -> DataFrame:
    """Records of ``documents``: url, title, content, content_hash, document_id beside doc_id and source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/docs/"), F.col("doc_id"))
    title = F.trim(F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(60)))
    rows = documents.select("doc_id", "source", "lang", url.alias("url"), title.alias("title"), text.alias("content"), T.content_hash(text).alias("content_hash"))
    return rows.withColumn("document_id", T.stable_id("doc", F.col("url"), F.col("content_hash")))


def snapshots(documents: DataFrame, labels: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two versions of one corpus: the documents, and what a cleaning release makes of them.

    The release drops documents labelled of low quality, adds a notice to toxic ones and
    takes in the benchmark's items.
    """
    old = corpus(documents).select("url", "title", "content", "content_hash")
    marks = labels.select("doc_id", "quality", "toxic")
    kept = documents.join(marks, "doc_id", "left").where("quality is null or quality <> 0")
    notice = F.lit("\nThis page is deprecated; see the security notice and the new pricing plan.")
    kept = kept.withColumn("text", F.when(F.col("toxic") == 1, F.concat("text", notice)).otherwise(F.col("text")))
    items = benchmark.select(F.concat(F.lit("https://benchmark.example/items/"), F.col("item_id")).alias("url"), F.concat(F.lit("Item "), F.col("item_id")).alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    added = items.withColumn("content_hash", T.content_hash(F.col("content")))
    return old, corpus(kept).select("url", "title", "content", "content_hash").unionByName(added)


def duplicates(records: DataFrame, key: str = "doc_id", digest: Column | None = None) -> DataFrame:
    """(key, first_key): the first record with the same digest; a first record is its own.

    The winner per digest is an aggregate, which combines before the shuffle, and records of a
    digest that many share meet it where they are.
    """
    digest = F.col("content_hash") if digest is None else digest
    rows = records.select(F.col(key).alias("key"), digest.alias("digest"))
    first = rows.groupBy("digest").agg(F.min("key").alias("first_key"))
    return join_split(rows.where("digest is not null"), first, "digest", 160).select(F.col("key").alias(key), "first_key")


def duplicate_stats(records: DataFrame) -> DataFrame:
    counted = records.groupBy("content_hash").agg(F.count("*").alias("n"))
    out = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.count("*").alias("unique_items"))
    rate = F.when(F.col("checked") > 0, F.round((F.col("checked") - F.col("unique_items")) / F.col("checked"), 6)).otherwise(0.0)
    return out.select("checked", "unique_items", (F.col("checked") - F.col("unique_items")).alias("duplicates"), rate.alias("duplicate_rate"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").otherwise("poor")


def pack_score(records: DataFrame, expected_domains: list[str]) -> DataFrame:
    """One row: a corpus's score of 100, less penalties for empty, duplicate and off-domain records."""
    rows = records.select((F.trim("content") == "").alias("empty"), F.col("content_hash"), (~U.any_of([U.in_domain(U.host(F.col("url")), d) for d in expected_domains])).alias("off"), "url")
    totals = rows.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("empty").cast("long")), F.lit(0)).alias("empty_records"))
    distinct = rows.groupBy("content_hash").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_records"))
    off = rows.groupBy("url").agg(F.max("off").alias("off")).agg(F.coalesce(F.sum(F.col("off").cast("long")), F.lit(0)).alias("off_domain_urls"))
    # three ungrouped aggregates, one row each
    one = totals.join(F.broadcast(distinct)).join(F.broadcast(off))
    lost = (
        F.when(F.col("records") == 0, 35).otherwise(0)
        + F.least(F.lit(20), 5 * F.col("empty_records"))
        + F.least(F.lit(15), 3 * F.col("duplicate_records"))
        + F.least(F.lit(25), 8 * F.col("off_domain_urls"))
    )
    score = F.greatest(F.lit(0), F.lit(100) - lost).cast("long")
    return one.select("records", "empty_records", "duplicate_records", "off_domain_urls", score.alias("score"), grade(score).alias("grade"))


def citations(records: DataFrame, score: Column) -> DataFrame:
    """One row per url with counts and hashes, numbered S1, S2, ... by falling score and url."""
    rows = records.select("url", "content_hash", T.word_tokens(F.col("content")).alias("tokens"), score.alias("score"))
    by_url = rows.groupBy("url").agg(F.count("*").alias("record_count"), F.sum("tokens").alias("token_count"), F.max("score").alias("score"), F.array_sort(F.collect_set("content_hash")).alias("content_hashes"))
    return numbered(by_url, F.col("score").desc(), F.col("url"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with citation_id S1, S2, ... in order, without gathering them in one task.

    A range sort deals rows to partitions in order; a partition's first number follows
    from the counts of those before it, one row each.
    """
    ordered = cut(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", "_first", before.alias("_before"))
    joined = ordered.join(F.broadcast(starts), "_part")
    return joined.withColumn("ordinal", F.col("_at") - F.col("_first") + F.col("_before") + 1).withColumn("citation_id", F.concat(F.lit("S"), F.col("ordinal"))).drop("_part", "_at", "_first", "_before")


def record_ordinals(records: DataFrame, group: str, order: str) -> DataFrame:
    """Each record's place within its url or source, as S{n}.{m} numbers use it."""
    return running_sums(records, [group], [order], {"record_ordinal": F.lit(1)})


def manifest(records: DataFrame, by: str = "source") -> DataFrame:
    rows = records.select(by, "content_hash", T.word_tokens(F.col("content")).alias("tokens"), F.octet_length("content").alias("bytes"))
    return rows.groupBy(by).agg(F.count("*").alias("record_count"), F.countDistinct("content_hash").alias("distinct_hashes"), F.sum("tokens").alias("token_count"), F.sum("bytes").cast("long").alias("byte_count"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per url: added, removed, changed, title_changed or unchanged."""
    side = lambda d, p: d.groupBy("url").agg(F.array_sort(F.collect_set("content_hash")).alias(p + "_hashes"), F.array_sort(F.collect_set("title")).alias(p + "_titles"))
    both = side(old, "old").join(side(new, "new"), "url", "full_outer")
    status = (
        F.when(F.col("old_hashes").isNull(), "added")
        .when(F.col("new_hashes").isNull(), "removed")
        .when(F.col("old_hashes") != F.col("new_hashes"), "changed")
        .when(F.col("old_titles") != F.col("new_titles"), "title_changed")
        .otherwise("unchanged")
    )
    return both.select("url", status.alias("status"))


def changed_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, before, after) of urls whose content differs; a missing side is empty, ``added`` tells."""
    a = old.select("url", F.col("content").alias("before"), F.col("content_hash").alias("old_hash"))
    b = new.select("url", F.col("content").alias("after"), F.col("content_hash").alias("new_hash"))
    both = a.join(b, "url", "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    return both.select("url", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.col("old_hash").isNull().alias("added"), F.col("new_hash").isNull().alias("removed"), "old_hash", "new_hash")


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, change, n): lines as clauses, keyed by their text and how often it came before."""
    def clauses(d: DataFrame, name: str) -> DataFrame:
        lines = d.select("url", F.explode(F.split("content", "\n")).alias("line")).where(F.trim("line") != "")
        return lines.groupBy("url", F.xxhash64("line").alias("clause")).agg(F.count("*").alias(name))

    both = clauses(old, "a").join(clauses(new, "b"), ["url", "clause"], "full_outer").fillna(0, ["a", "b"])
    counted = both.groupBy("url").agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed"))
    pairs = counted.select("url", F.explode(F.array(F.struct(F.lit("added").alias("change"), F.col("added").alias("n")), F.struct(F.lit("removed").alias("change"), F.col("removed").alias("n")))).alias("c"))
    return pairs.select("url", "c.change", "c.n").where("n > 0")
