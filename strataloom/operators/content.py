"""Main content of pages: a table of elements as intervals, scored, pruned and rendered; the best of several extractions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strataloom.lineage import slices
from strataloom.operators.markdown import markdown_of

# The selectors of content in order, and of what is no content.
CONTENT = ["#content-container", 'div[id^="S:"]', "article", "main", '[role="main"]', ".content", ".main-content", ".post-content", ".article-content", ".documentation", ".docs-content", "#content", "#main-content", "#documentation"]
REMOVED = """
nav header footer aside .nav .navbar .sidebar .footer .header .menu .toc .table-of-contents .advertisement .ads .social-share .comments .related-posts
[role="navigation"] [role="banner"] [role="contentinfo"] [aria-hidden="true"] script style noscript iframe svg
.cookie-banner .cookie-consent .cookie-notice .cookielaw-banner .cookiebot .gdpr .gdpr-banner .consent-banner .consent-popup .cc-window .cc-banner
.osano-cm-window .osano-cm-dialog #onetrust-banner-sdk #onetrust-consent-sdk #onetrust-pc-sdk .ot-sdk-container .iubenda-cs-container .termly-styl-banner
[aria-label*="cookie"i] [aria-label*="consent"i] [aria-label*="gdpr"i] .sr-only
""".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style template".split())
_WORD, _LOADING = re.compile(r"[\w'-]+"), re.compile(r"\bloading\b", re.I)
_PART = re.compile(r"[\s.]+")

_ELEMENT = "tag string, fits array<int>, unwanted boolean, last int, piece int, stop int, at int, end int"
_PAGE = f"elements array<struct<{_ELEMENT}>>, headings array<int>, chars array<long>, words array<long>, loading array<long>, parts array<long>, waits array<long>, silent array<boolean>, owner array<int>, piece_at array<int>, piece_end array<int>"


class _Elements(HTMLParser):
    """Elements in the order of their starts, each with the last one within it, its pieces of text and its place in the page.

    An end tag closes the nearest open element of its name and all within; others are skipped.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.starts = [0, *(m.end() for m in re.finditer("\n", page))]
        self.size = len(page)
        self.elements: list[dict] = []
        self.open: list[int] = []
        self.pieces: list[tuple[str, int, int, int]] = []  # text, owner, from, to in the page
        self.text_at: int | None = None
        self.feed(page)
        self.close()
        self._end_text(self.size)
        for node in self.open:
            self._shut(node, self.size)

    def _place(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _end_text(self, to: int) -> None:
        if self.pieces and self.pieces[-1][3] < 0:
            text, owner, at, _ = self.pieces[-1]
            self.pieces[-1] = (text, owner, at, to)

    def _shut(self, node: int, end: int) -> None:
        self.elements[node] |= {"last": len(self.elements) - 1, "stop": len(self.pieces), "end": end}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = self._place()
        self._end_text(at)
        values = {k: v or "" for k, v in reversed(attrs)}
        node = len(self.elements)
        self.elements.append({"tag": tag, "id": values.get("id"), "classes": (values.get("class") or "").split(), "role": values.get("role"), "label": values.get("aria-label"), "hidden": values.get("aria-hidden"), "piece": len(self.pieces), "at": at})
        if tag in VOID:
            self._shut(node, at + len(self.get_starttag_text() or ""))
        else:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self._place()
        self._end_text(at)
        if all(self.elements[n]["tag"] != tag for n in self.open):
            return
        while True:
            node = self.open.pop()
            found = self.elements[node]["tag"] == tag
            self._shut(node, at + len(tag) + 3 if found else at)
            if found:
                return

    def handle_data(self, data: str) -> None:
        at = self._place()
        self._end_text(at)
        text = " ".join(data.split())
        if text:
            self.pieces.append((text, self.open[-1] if self.open else -1, at, -1))

    def _other(self, *_: str) -> None:
        self._end_text(self._place())

    handle_comment = handle_decl = handle_pi = unknown_decl = _other


def _sums(values: list[int]) -> list[int]:
    return [0, *accumulate(values)]


_SELECTOR = re.compile(r"""(?P<tag>[a-z0-9]*)(?:#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?P<op>[*^]?=)"(?P<value>[^"]*)"(?P<fold>i?)\])?\Z""")
_HELD = {"id": "id", "role": "role", "aria-label": "label", "aria-hidden": "hidden"}
_COMPARED = {"=": str.__eq__, "^=": str.startswith, "*=": str.__contains__}


def matches(element: dict, selector: str) -> bool:
    """Whether an element fits a selector of one step: a tag, an id, a class, or an attribute that is, begins with or holds a value."""
    return _test(selector)(element)


def _test(selector: str) -> Callable[[dict], bool]:
    m = _SELECTOR.match(selector.replace('" i]', '"i]'))
    if not m:
        raise ValueError(f"selector {selector!r}")
    tag, own, cls, fold, value = m["tag"], m["id"], m["cls"], m["fold"], m["value"]
    compared, name = _COMPARED.get(m["op"]), _HELD[m["attr"]] if m["attr"] else None

    def fits(element: dict) -> bool:
        if tag and element["tag"] != tag or own and element["id"] != own or cls and cls not in element["classes"]:
            return False
        held = (element[name] or "") if name else ""
        return not name or compared(held.lower() if fold else held, value.lower() if fold else value)

    return fits


def _page_row(page: str, lists: list[list[Callable[[dict], bool]]], removed: list[Callable[[dict], bool]]) -> dict:
    found = _Elements(page)
    plain: dict[str, tuple] = {}  # most elements have nothing but a tag, so all of one tag fit alike
    for element in found.elements:
        bare = not (element["id"] or element["classes"] or element["role"] or element["label"] or element["hidden"])
        told = plain.get(element["tag"]) if bare else None
        if told is None:
            told = [next((n for n, fits in enumerate(tests) if fits(element)), None) for tests in lists], any(fits(element) for fits in removed)
            if bare:
                plain[element["tag"]] = told
        element["fits"], element["unwanted"] = told
    texts = [text for text, *_ in found.pieces]
    silent = [owner >= 0 and found.elements[owner]["tag"] in _SILENT for _, owner, _, _ in found.pieces]
    shown = ["" if quiet else text for text, quiet in zip(texts, silent, strict=True)]
    parts = [[p for p in _PART.split(text.lower()) if p] for text in shown]
    return {
        "elements": found.elements,
        "headings": [n for n, e in enumerate(found.elements) if e["tag"] in ("h1", "h2")],
        "chars": _sums([len(t) + 1 if t else 0 for t in shown]),
        "words": _sums([len(_WORD.findall(t)) for t in shown]),
        "loading": _sums([len(_LOADING.findall(t)) for t in shown]),
        "parts": _sums([len(p) for p in parts]),
        "waits": _sums([sum(x == "loading" for x in p) for p in parts]),
        "silent": silent,
        "owner": [p[1] for p in found.pieces],
        "piece_at": [p[2] for p in found.pieces],
        "piece_end": [p[3] for p in found.pieces],
    }


def page_elements(pages: DataFrame, page: str = "html", lists: Sequence[Sequence[str]] = (CONTENT,), removed: Sequence[str] = REMOVED) -> DataFrame:
    """``pages`` with a struct ``dom``: elements as intervals, and running sums over the pieces of text.

    An element holds the elements up to its ``last``, the pieces from ``piece`` to before ``stop`` and the page's characters from
    ``at`` to before ``end``; so what it holds is a difference of two running sums.  Its ``fits`` are the number of the first
    selector that it fits in each of ``lists``; ``unwanted`` tells that it fits one of ``removed``.  Texts of scripts, styles and
    templates count as nothing.  A null page is empty.
    """
    kind = T.StructType.fromDDL(_PAGE)
    shape = to_arrow_type(kind)
    for selector in [*removed, *(s for own in lists for s in own)]:
        _test(selector)

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tests, unwanted = [[_test(s) for s in own] for own in lists], [_test(s) for s in removed]
        for batch in batches:
            yield pa.concat_arrays([pa.array([_page_row(text or "", tests, unwanted) for text in part.to_pylist()], shape) for part in slices(batch)])

    return pages.withColumn("dom", F.arrow_udf(parse, kind)(F.col(page).cast("string")))


def _within(dom: Column, name: str, element: Column) -> Column:
    return dom[name][element["stop"]] - dom[name][element["piece"]]


def content_score(dom: Column, node: Column, element: Column, selectors: Sequence[str], place: int = 0) -> tuple[Column, Column]:
    """(score, number of the first selector that fits) of a possible main element; 0 for short ones and those that only say they are loading.

    ``selectors`` are those that ``page_elements`` has compared as the list of number ``place``.
    """
    number = element["fits"][place]
    length = F.greatest(F.lit(0), _within(dom, "chars", element) - 1)
    words, loading = _within(dom, "words", element), _within(dom, "loading", element)
    stuck = (loading > 0) & ((words <= 2 * loading + 8) | (loading / F.greatest(words, F.lit(1)) > 0.5))
    by_id = number.isin([n for n, s in enumerate(selectors) if s.startswith("#")])
    heading = F.exists(dom["headings"], lambda h: (h > node) & (h <= element["last"]))
    bonus = F.greatest(F.lit(0), 30 - number) + F.when(by_id, 40).otherwise(0) + F.when(element["tag"].isin("article", "main"), 20).otherwise(0) + F.when(heading, 80).otherwise(0)
    score = length + bonus - F.least(20 * loading, F.floor(length / 4))
    return F.when(number.isNull() | (length <= 100) | stuck, 0).otherwise(F.greatest(F.lit(0), score)).cast("long"), number


def main_content(pages: DataFrame, page: str = "html", selectors: Sequence[str] = CONTENT, removed: Sequence[str] = REMOVED) -> DataFrame:
    """``pages`` with ``content_html``, ``content_text``, ``content_score`` and ``content_selector``.

    The best scored of the elements that fit a selector is the content, the earlier selector's and then the earlier of equal
    ones; where none has a score, the body, with a null selector, else nothing.  From it go the elements that fit ``removed``, and
    elements that say nothing but "loading".  Only parsing, which tells the selectors that elements fit, is Python; the rest
    are column expressions on one row a page, without a shuffle.  An empty or null page has empty content.
    """
    return content_of(page_elements(pages, page, [selectors], removed), page, selectors).drop("dom")


def content_of(parsed: DataFrame, page: str, selectors: Sequence[str], place: int = 0) -> DataFrame:
    """``parsed``, pages with their ``dom``, with the columns of ``main_content`` by the list of selectors of number ``place``."""
    dom = F.col("dom")

    def candidate(element: Column, node: Column) -> Column:
        score, number = content_score(dom, node, element, selectors, place)
        return F.struct(score.alias("score"), (-F.coalesce(number, F.lit(99))).alias("order"), (-node).alias("place"), number.alias("number"))

    best = F.array_max(F.filter(F.transform(dom["elements"], candidate), lambda c: c["score"] > 0))
    body = F.array_position(F.transform(dom["elements"], lambda e: e["tag"]), "body") - 1
    chosen = parsed.withColumn("best", best)
    at = F.coalesce(-F.col("best.place"), F.when(body >= 0, body.cast("int")))
    chosen = chosen.withColumn("main", F.when(at.isNotNull(), F.get(dom["elements"], at))).withColumn("_main", at)
    main = F.col("main")
    waiting = lambda e: (_within(dom, "parts", e) > 0) & (_within(dom, "parts", e) == _within(dom, "waits", e))
    inside = F.filter(dom["elements"], lambda e, n: (n >= F.col("_main")) & (n <= main["last"]) & (e["unwanted"] | waiting(e)))
    # of elements within each other the outermost: those that begin after all before have ended
    outer = F.aggregate(inside, F.array().cast("array<struct<at:int,end:int,piece:int,stop:int>>"), lambda a, e: F.when((F.size(a) == 0) | (e["at"] >= F.try_element_at(a, F.lit(-1))["end"]), F.concat(a, F.array(F.struct(e["at"], e["end"], e["piece"], e["stop"])))).otherwise(a))
    chosen = chosen.withColumn("cut", F.when(main.isNotNull(), outer))
    text = F.col(page).cast("string")
    slices = F.aggregate("cut", F.struct(F.lit("").alias("html"), main["at"].alias("at")), lambda a, c: F.struct(F.concat(a["html"], F.substr(text, a["at"] + 1, c["at"] - a["at"])).alias("html"), c["end"].alias("at")))
    kept_html = F.when(main.isNotNull(), F.concat(slices["html"], F.substr(text, slices["at"] + 1, F.greatest(F.lit(0), main["end"] - slices["at"])))).otherwise("")
    pieces = F.filter(F.sequence(main["piece"], main["stop"] - 1), lambda p: ~dom["silent"][p] & ~F.exists("cut", lambda c: (p >= c["piece"]) & (p < c["stop"])))
    words = F.transform(pieces, lambda p: F.btrim(F.regexp_replace(F.substr(text, dom["piece_at"][p] + 1, dom["piece_end"][p] - dom["piece_at"][p]), r"\s+", " ")))
    kept_text = F.when(main["stop"] > main["piece"], F.array_join(words, " ")).otherwise("")
    out = chosen.withColumn("content_html", kept_html).withColumn("content_text", F.coalesce(kept_text, F.lit("")))
    named = F.get(F.array(*map(F.lit, selectors)), F.col("best.number"))
    out = out.withColumn("content_score", F.coalesce("best.score", F.lit(0)).cast("long")).withColumn("content_selector", named)
    return out.select(*parsed.columns, "content_html", "content_text", "content_score", "content_selector")


# ---------------------------------------------------------------- the best of several

#: What counts as boilerplate when extractions are compared.
BOILERPLATE = r"(?i)\b(cookie|privacy policy|terms of use|subscribe|newsletter|sign in|log in|loading)\b"
#: Of extractions with equal scores the one with the higher number is taken.
TIES = {"dense": 2, "generic": 1}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extraction_score(markdown: Column) -> Column:
    """0 to 1 by words, distinct words, headings, links and code, less for short texts and boilerplate."""
    words = F.regexp_extract_all(markdown, F.lit(r"([A-Za-z0-9][A-Za-z0-9'-]{1,})"), F.lit(1))
    count = lambda pattern: F.regexp_count(markdown, F.lit(pattern))
    fences = F.floor((F.length(markdown) - F.length(F.replace(markdown, F.lit("```"), F.lit("")))) / 3 / 2)

    def score(words: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w))))
        score = F.least(F.size(words) / 700.0, F.lit(0.42)) + F.least(distinct / 350.0, F.lit(0.2)) + F.least(count(r"(?m)^#{1,6}\s+\S+") * 0.04, F.lit(0.16))
        score = score + F.least(count(r"\[[^\]]+]\([^)]+\)") * 0.015, F.lit(0.08)) + F.least(fences * 0.03, F.lit(0.06))
        score = score - F.when(F.size(words) < 30, 0.25).otherwise(0.0) - F.least(count(BOILERPLATE) * 0.035, F.lit(0.18))
        return F.greatest(F.lit(0.0), F.round(F.least(score, F.lit(1.0)), 4))

    return _once(words, score)


def best_extraction(candidates: dict[str, Column]) -> Column:
    """A struct (name, score, markdown, candidates): the best of those that are not blank, ties by ``TIES``; null if all are."""
    tried = F.array(*(F.struct(extraction_score(c).alias("score"), F.lit(TIES.get(name, 0)).alias("tie"), F.lit(name).alias("name"), c.alias("markdown")) for name, c in candidates.items()))
    left = F.filter(tried, lambda t: F.coalesce(F.trim(t["markdown"]), F.lit("")) != "")

    def best(left: Column) -> Column:
        first = F.array_max(left)
        return F.when(F.size(left) > 0, F.struct(first["name"].alias("name"), first["score"].alias("score"), first["markdown"].alias("markdown"), F.size(left).alias("candidates")))

    return _once(left, best)


def _rendered(page: Column, url: Column) -> Column:
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([markdown_of(p or "", u or "") for p, u in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string()) for a, b in zip(slices(pages), slices(urls), strict=True)])

    return F.arrow_udf(run, "string")(page, url)


def extract_best(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with ``extraction``: Markdown of the main content, or of the page's dense blocks if that scores higher.

    Dense blocks are the page without its chrome, wherever they are, so that pages whose text lies in no known
    container, or in several, are not cut to one.
    """
    lists = [CONTENT, ["body"]]
    generic = content_of(page_elements(pages, page, lists), page, CONTENT).select(*pages.columns, "dom", F.col("content_html").alias("_generic"))
    dense = content_of(generic, page, lists[1], 1).select(*pages.columns, "_generic", "content_html")
    both = dense.withColumn("_generic", _rendered(F.col("_generic"), F.col(url))).withColumn("_dense", _rendered(F.col("content_html"), F.col(url)))
    return both.select(*pages.columns, best_extraction({"generic": F.col("_generic"), "dense": F.col("_dense")}).alias("extraction"))
