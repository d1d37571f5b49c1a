"""What changed between two snapshots of a corpus, as one event per url."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from strataloom.functions import text as T

# A change lists that many edits, each with that many characters of a side.
MOST_EDITS = 100
SIDE_CHARS = 1000

_PLACES = ("old_line_start", "old_line_end", "new_line_start", "new_line_end")
_TEXTS = ("before", "after", "before_sha256", "after_sha256")
EDITS = Y.ArrayType(Y.StructType([Y.StructField("type", Y.StringType()), *[Y.StructField(n, Y.IntegerType()) for n in _PLACES], *[Y.StructField(n, Y.StringType()) for n in _TEXTS]]))


def side(records: DataFrame, order: str) -> DataFrame:
    """(url, n, hashes, titles, content, first_id) of each url's records (url, document_id, title, content, content_hash).

    Contents are joined in the given order by an empty line, so all texts of one url must
    fit a row: a url stands for one page and its few records, not for a site.  Null titles and contents are empty.
    """
    filled = records.where("url is not null").withColumn("content", F.coalesce("content", F.lit(""))).withColumn("title", F.coalesce("title", F.lit("")))
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "content", "document_id")))
    return filled.groupBy("url").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.when(F.col("content_hash") != "", F.col("content_hash")))).alias("hashes"),
        F.array_sort(F.collect_set("title")).alias("titles"),
        F.array_join(F.transform(texts, lambda x: x["content"]), "\n\n").alias("content"),
        texts[0]["document_id"].alias("first_id"),
    )


def _classes(url: Column, old: Column, new: Column) -> Column:
    """array<struct<classification, confidence>> of the classes whose terms occur, else 'other'."""
    low = F.lower(F.concat_ws("\n", url, old, new))
    found = T.classes_by_terms(low, T.CHANGE_TERMS, "other")
    return F.transform(found, lambda c: F.struct(c.alias("classification"), T.class_confidence(low, c, T.CHANGE_TERMS).alias("confidence")))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@F.pandas_udf(EDITS)
def line_edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edits that turn the lines of one text into those of another, at most ``MOST_EDITS``; null texts are empty."""
    for old, new in pairs:
        out = []
        for a, b in zip(old, new, strict=True):
            a, b = (a or "").splitlines(), (b or "").splitlines()
            edits = []
            for kind, a0, a1, b0, b1 in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
                if kind != "equal" and len(edits) < MOST_EDITS:
                    before, after = "\n".join(a[a0:a1])[:SIDE_CHARS], "\n".join(b[b0:b1])[:SIDE_CHARS]
                    edits.append(
                        {
                            "type": kind,
                            "old_line_start": a0,
                            "old_line_end": a1,
                            "new_line_start": b0,
                            "new_line_end": b1,
                            "before": before,
                            "after": after,
                            "before_sha256": _sha256(before),
                            "after_sha256": _sha256(after),
                        }
                    )
            out.append(edits)
        yield pd.Series(out)


def changed_urls(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Urls whose hashes or titles differ between two snapshots, with both sides' facts.

    Columns: url, old_* and new_* of ``side`` (null where a snapshot lacks the url),
    structural (array of kinds), candidates (classes with confidences) and
    idempotency_key, a digest of the url and both lists of hashes: the same change
    gives the same key in every run.
    """
    a, b = (side(rows, order).select("url", *[F.col(c).alias(f"{name}_{c}") for c in ("n", "hashes", "titles", "content", "first_id")]) for rows, name in ((old, "old"), (new, "new")))
    both = a.join(b, "url", "full")
    same = F.col("old_hashes").eqNullSafe(F.col("new_hashes")) & F.col("old_titles").eqNullSafe(F.col("new_titles"))
    none = F.array().cast("array<string>")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("old_n").isNull(), F.lit("document_added")).when(F.col("new_n").isNull(), F.lit("document_removed")),
            F.when(F.coalesce("old_n", F.lit(0)) != F.coalesce("new_n", F.lit(0)), F.lit("record_count_changed")),
            F.when(F.coalesce("old_titles", none) != F.coalesce("new_titles", none), F.lit("title_changed")),
        )
    )
    joined = [F.array_join(F.coalesce(c, none), ",") for c in ("old_hashes", "new_hashes")]
    return both.where(~same).select(
        "*",
        kinds.alias("structural"),
        _classes(F.col("url"), F.coalesce("old_content", F.lit("")), F.coalesce("new_content", F.lit(""))).alias("candidates"),
        F.sha2(F.concat_ws("\n", "url", *joined), 256).alias("idempotency_key"),
    )


def change_events(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``changed_urls`` with the line edits of each."""
    return changed_urls(old, new, order).withColumn("textual", line_edits("old_content", "new_content"))
