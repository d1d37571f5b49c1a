"""Markdown documents cut into chunks of a bounded number of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.lineage import slices

#: An ATX heading and its words.
_HEADING = re.compile(r"#{1,6}\s+(.+?)\s*#*\s*$")


def _tokens(text: str) -> int:
    return max(1, len(text) // 4)


def _coded(lines: list[str]) -> list[bool]:
    """Which lines open, close or lie within a fenced block."""
    fence, out = "", []
    for line in lines:
        mark = line.strip()[:3]
        mark = mark if mark in ("```", "~~~") else ""
        out.append(bool(mark or fence))
        if mark:
            fence = {"": mark, mark: ""}.get(fence, fence)
    return out


def heading_sections(body: str) -> list[tuple[str | None, str]]:
    """(heading, text with its heading line); what precedes the first heading has none."""
    lines = body.splitlines(keepends=True)
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for line, coded in zip(lines, _coded(lines), strict=True):
        if not coded and (heading := _HEADING.match(line.rstrip("\n"))):
            out.append((heading[1].strip(), []))
        out[-1][1].append(line)
    return [(heading, "".join(own)) for heading, own in out if own]


def paragraphs(section: str) -> list[str]:
    """Parts between blank lines; blank lines within fenced blocks part nothing."""
    lines, out = section.split("\n"), [[]]
    for line, coded in zip(lines, _coded(lines), strict=True):
        if out[-1] and not coded and not line.strip():
            out.append([])
        else:
            out[-1].append(line)
    return ["\n".join(p) for p in out if p]


def _parts(body: str, most: int) -> Iterator[tuple[str, str | None, int, bool]]:
    """(text, heading, tokens, starts a chunk): sections, and the paragraphs of those over ``most``."""
    for heading, section in heading_sections(body):
        if _tokens(section) <= most:
            yield section, heading, _tokens(section), False
        else:
            yield from ((p, heading, _tokens(p), n == 0) for n, p in enumerate(paragraphs(section)))


def chunks(markdown: str, most: int) -> list[tuple[int, str | None, int, str]]:
    """(index, heading, tokens, text) of one document's chunks.

    Parts join a chunk while the sum of their tokens stays within ``most``; a paragraph
    over it is a chunk of its own.  The first chunk begins with the document's
    front matter, and a chunk's tokens are counted on its final text.
    """
    matter = re.match(r"---(?s:.*?)\n---[^\n]*(?:\n|\Z)", markdown)
    matter = matter[0] if matter else ""
    groups: list[list[tuple[str, str | None, int]]] = []
    total = 0
    for text, heading, size, starts in _parts(markdown[len(matter) :].strip(), most):
        if starts:
            total = most
        if not text.strip():
            continue
        if not groups or total + size > most:
            groups.append([])
            total = 0
        groups[-1].append((text, heading, size))
        total += size
    out = []
    for number, group in enumerate(groups):
        text = ("" if number else matter) + "\n\n".join(t.strip() for t, _, _ in group)
        text = text.strip() + "\n"
        out.append((number, next((h for _, h, _ in group if h is not None), None), _tokens(text), text))
    return out


def chunk_documents(docs: DataFrame, key: str = "doc_id", content: str = "content", max_tokens: int = 4000, keep: Sequence[str] = ()) -> DataFrame:
    """(key, chunk_index, heading, token_count, text, chunk_hash) of every document's chunks, and the columns to ``keep``.

    Null and blank contents have no chunks.  A few rows are read at a time and their chunks go
    on at once, so memory follows the longest documents alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            rows = [(n, *c) for n, value in enumerate(batch.column(0).to_pylist()) for c in chunks(value or "", max_tokens)]
            at, index, heading, size, text = zip(*rows, strict=True) if rows else [()] * 5
            kept = pa.array(at, pa.int64())
            yield pa.record_batch([*(c.take(kept) for c in batch.columns[1:]), pa.array(index, pa.int32()), pa.array(heading, pa.string()), pa.array(size, pa.int64()), pa.array(text, pa.string())], [*columns, "chunk_index", "heading", "token_count", "text"])

    columns = [key, *keep]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    source = docs.select(F.col(content).cast("string"), *columns)
    made = source.mapInArrow(run, kinds + "chunk_index int, heading string, token_count long, text string")
    return made.withColumn("chunk_hash", T.content_hash(F.col("text")))
