"""Personal data and secrets replaced in texts, and counted."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import REDACTIONS
from strataloom.lineage import slices


def matches(text: str, rules: Sequence[tuple[str, re.Pattern]]) -> list[tuple[int, int, str]]:
    """(start, end, rule) of matches that do not overlap: the first, then the longest, then by name."""
    found = sorted((m.start(), -m.end(), name) for name, rule in rules for m in rule.finditer(text))
    out: list[tuple[int, int, str]] = []
    for start, end, name in found:
        if not out or start >= out[-1][1]:
            out.append((start, -end, name))
    return out


def redact(docs: DataFrame, key: str = "doc_id", content: str = "content", rules: Sequence[tuple[str, str]] = REDACTIONS) -> DataFrame:
    """(key, redacted, counts): texts with ``[REDACTED:rule]`` in place of matches, and matches by rule.

    A null text stays null and counts nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(name, re.compile(pattern)) for name, pattern in rules]
        for batch in chain.from_iterable(map(slices, batches)):
            texts, counts = [], []
            for value in batch.column(1).to_pylist():
                at, parts, spans = 0, [], matches(value or "", compiled)
                for start, end, name in spans:
                    parts += [value[at:start], f"[REDACTED:{name}]"]
                    at = end
                texts.append(value and "".join(parts) + value[at:])
                counts.append(list(Counter(name for _, _, name in spans).items()))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int64()))], ["key", "redacted", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(content).cast("string").alias("content"))
    return source.mapInArrow(run, f"key {kind}, redacted string, counts map<string, bigint>").withColumnRenamed("key", key)


def sensitive_totals(redacted: DataFrame) -> DataFrame:
    """(rule, documents, hits) over ``redact``'s rows."""
    rows = redacted.select(F.explode("counts").alias("rule", "n"))
    return rows.groupBy("rule").agg(F.count("*").alias("documents"), F.sum("n").alias("hits"))
