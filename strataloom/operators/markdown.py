"""HTML pages rendered as Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.lineage import slices

#: Elements without text of their own to show.
_HIDDEN = frozenset("script style noscript template head svg iframe".split())
_MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_", "code": "`", "del": "~~", "s": "~~"}
_BLOCKS = frozenset("p div section article main header footer nav aside ul ol dl table blockquote figure form h1 h2 h3 h4 h5 h6 pre hr".split())


def _language(attrs: dict[str, str | None]) -> str:
    found = re.search(r"\blang(?:uage)?-([\w+-]+)", attrs.get("class") or "")
    return found[1] if found else ""


class _Renderer(HTMLParser):
    """Collects finished Markdown blocks while the parser walks the page."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.blocks, self.line, self.prefix = base, [], [], ""
        self.hidden, self.quotes, self.lists, self.hrefs, self.marks = 0, 0, [], [], []
        self.fence: list[str] | None = None
        self.cells: list[str] | None = None
        self.in_cell, self.language = False, ""
        self.rows: list[list[str]] = []

    def close_block(self) -> None:
        text = re.sub(r"[ \t\r\n]+", " ", "".join(self.line)).replace("\x00", "  \n").strip()
        if text:
            self.blocks.append("> " * self.quotes + self.prefix + text)
        self.line, self.prefix = [], ""

    def close_cell(self) -> None:
        if self.cells is not None and self.in_cell:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.line)).strip().replace("|", "\\|"))
            self.line, self.in_cell = [], False

    def close_row(self) -> None:
        self.close_cell()
        if self.cells is not None:
            self.rows.append(self.cells)
        self.cells = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in _BLOCKS and self.cells is None:
            self.close_block()
        if re.fullmatch("h[1-6]", tag):
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            self.close_block()
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.prefix = "  " * max(len(self.lists) - 1, 0) + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.fence = []
            self.language = _language(values)
        elif tag == "code" and self.fence is not None:
            self.language = self.language or _language(values)
        elif tag == "hr":
            self.blocks.append("---")
        elif tag == "br":
            self.line.append("\x00")
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self.close_row()
            self.cells, self.in_cell = [], False
        elif tag in ("td", "th"):
            self.close_cell()
            self.line, self.in_cell = [], True
        elif tag == "a":
            self.hrefs.append(values.get("href") or "")
            self.line.append("[" if self.hrefs[-1] else "")
        elif tag == "img" and values.get("src"):
            self.line.append(f"![{values.get('alt') or ''}]({urljoin(self.base, values['src'])})")
        elif tag in _MARKS:
            self.line.append(_MARKS[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
            return
        if self.hidden:
            return
        if tag == "pre" and self.fence is not None:
            self.blocks.append(f"```{self.language}\n" + "".join(self.fence).strip("\n") + "\n```")
            self.fence = None
        elif self.fence is not None:
            return
        elif tag in ("td", "th"):
            self.close_cell()
        elif tag == "tr":
            self.close_row()
        elif tag == "table":
            self.close_row()
            if not self.rows:
                return
            width = max(map(len, self.rows))
            rows = [r + [""] * (width - len(r)) for r in self.rows]
            rows.insert(1, ["---"] * width)
            self.blocks.append("\n".join("| " + " | ".join(r) + " |" for r in rows))
            self.rows = []
        elif tag == "a" and self.hrefs:
            href = self.hrefs.pop()
            self.line.append(f"]({urljoin(self.base, href)})" if href else "")
        elif tag in _MARKS:
            self.line.append(_MARKS[tag])
        elif (tag in _BLOCKS or tag == "li") and self.cells is None:
            self.close_block()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.quotes -= tag == "blockquote" and self.quotes > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.line if self.fence is None else self.fence).append(data)


def markdown_of(page: str, base: str) -> str:
    """A page's Markdown; list items and table rows follow each other, other blocks are parted by a blank line."""
    renderer = _Renderer(base)
    renderer.feed(page)
    renderer.close()
    renderer.close_block()
    out = []
    for block in renderer.blocks:
        item = re.match(r"\s*(?:- |\d+\. )", block)
        out.append(("" if not out else "\n" if item and was else "\n\n") + block)
        was = item
    return "".join(out)


def to_markdown(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, content): each page as Markdown, links made absolute.

    Comments, scripts, styles and the head are left out; a null page gives an empty content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            made = [markdown_of(p or "", u or "") for u, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["key", "url", "content"])

    kind = pages.schema[key].dataType.simpleString()
    source = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page"))
    return source.mapInArrow(run, f"key {kind}, url string, content string").withColumnRenamed("key", key)
