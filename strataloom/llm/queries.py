"""One query per operator, over its whole table, and the SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import table
from strataloom.llm.host_rules import apply_rules
from strataloom.llm.hnsw import nearest_neighbours
from strataloom.llm.html_text import extract_pages
from strataloom.llm.line_dedup import drop_boilerplate
from strataloom.llm.mixing import mix_sources
from strataloom.llm.near_dedup import near_duplicates
from strataloom.llm.packing import pack_documents
from strataloom.llm.quality import quality_scores
from strataloom.llm.resampling import resample
from strataloom.llm.suffix_dedup import remove_repeats
from strataloom.llm.token_alignment import align_tokenizers
from strataloom.llm.token_counts import edited_counts
from strataloom.llm.vector_dedup import vector_duplicates


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_boilerplate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "text", "lines_total", "lines_dropped")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every text: a word changed, a passage cut, a line added."""
    import public_tokenizers

    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, deleted, inserted: F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(F.floor(n / 3), 4, " edited"), edit(F.floor(n / 2), 40, ""), edit(n, 0, "\nOne line more, 2 words."))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return edited_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_sources(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


def op8_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_suffix_dedup, op3_quality_rules, op4_line_dedup, op5_token_counts, op6_quality_classifier, op7_source_mixing, op8_hnsw_neighbours, op9_best_fit_packing, op10_near_dedup, op11_tokenizer_alignment, op12_importance_resampling, op13_embedding_near_dedup)}


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM places
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, source, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source
), prior AS (
  SELECT sum(f) / sum(n) AS m, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS per_doc FROM hosts
), strength AS (
  SELECT m, CASE WHEN m * (1 - m) > 0 THEN greatest(m * (1 - m) / greatest(v - m * (1 - m) * per_doc, m * (1 - m) * 0.001) - 1, 1) ELSE 1 END AS k FROM prior
), verdicts AS (
  SELECT source, (f + m * k) / (n + k) <= 0.5 AS ok FROM hosts, strength
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), pages AS (
  SELECT source, count(*) AS pages FROM d GROUP BY source
), counts AS (
  SELECT source, line, count(*) AS n FROM (
    SELECT source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))))) AS line FROM d
  ) WHERE line <> '' GROUP BY source, line
), frequent AS (
  SELECT counts.source, list(line) AS bad FROM counts JOIN pages ON counts.source IS NOT DISTINCT FROM pages.source
  WHERE n >= 5 AND n > 0.1::DOUBLE * pages GROUP BY counts.source
), kept AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []::VARCHAR[]), trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS kept
  FROM d LEFT JOIN frequent ON d.source IS NOT DISTINCT FROM frequent.source
)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, len(lines) AS lines_total, len(lines) - len(kept) AS lines_dropped FROM kept
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op4_line_dedup": OP4_SQL}
