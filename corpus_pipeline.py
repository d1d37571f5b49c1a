"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import cut, gathered, join_small, shared_folder, table
from strataloom.llm.line_dedup import drop_boilerplate
from strataloom.llm.mixing import mix_sources
from strataloom.llm.near_dedup import near_duplicates
from strataloom.llm.packing import pack_documents
from strataloom.llm.quality import quality_scores


def numbered(docs: DataFrame) -> DataFrame:
    """(_row, doc): ``docs`` as structs with a number each, written so that the numbers stay the same.

    A struct keeps the documents' columns apart from the stages' own, whatever their names.
    """
    path = f"{shared_folder(docs.sparkSession)}/numbered-{uuid.uuid4().hex}"
    docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("doc")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, each judged by its own text.

    Scores depend on texts alone, so rejected texts, by their digests, tell which rows go,
    whatever their keys.  An empty or null text is judged like any other; an empty table stays empty.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("_text")
    scores = quality_scores(docs.select("doc_id", "text", digest), table(spark, sf_dir, "labels"), row="_text")
    rejected = cut(scores.where("predicted = 0").select("_text").distinct())
    return join_small(docs.select(F.struct("*").alias("doc"), digest), rejected, "_text", "left_anti", 48).select("doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines, none dropped, repeated rows included.

    A null text becomes empty; an empty table stays empty.
    """
    others = F.struct(*(c for c in docs.columns if c != "text")).alias("doc")
    rows = drop_boilerplate(docs.select(others, "text", "source"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(own[c].alias(c) if c in own else F.col("doc")[c].alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least key.

    Rows without a key come after all keys; repeated keys and rows without one are told
    apart by their texts alone, so that of repeated rows one stays.  Texts without words
    are no duplicates; an empty table stays empty.
    """
    rows = numbered(docs)
    classes = gathered(near_duplicates(rows.select("_row", "doc.text"), key="_row").select("_row", "component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_key"), "doc_id", "_row"))
    kept = classes.join(rows.select("_row", "doc.doc_id"), "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    copies = gathered(classes.select("_row").join(kept, "_row", "left_anti"))
    return join_small(rows, copies, "_row", "left_anti", 16).select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, with or without a key.

    Ties are drawn by the key and then by the text; repeated rows are documents of their own;
    a document without words is not taken.  An empty table stays empty.
    """
    rows = numbered(docs)
    mixed = mix_sources(rows.select("_row", "doc.doc_id", "doc.text", "doc.source"), key="_row", draw_by="doc_id")
    repeats = cut(mixed.where("repeats > 0").select("_row", F.col("repeats").alias("_repeats")))
    taken = join_small(rows, repeats, "_row", "inner", 24)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("_repeats").cast("int")))).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    Null and empty texts are packed as their end token alone, repeated rows as often as they occur.
    """
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Training, hashing and packing are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
