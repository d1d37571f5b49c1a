"""Column functions over raw pages that need no parser, and parsers as Arrow functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.urls import any_of, host, in_domain, netloc, scheme

# Markers by which responses and frameworks are told.
WALLS = {
    "bot_challenge": ["client challenge", "verify you are human", "checking your browser", "captcha"],
    "auth_wall": ["sign in to continue", "log in to continue", "authentication required"],
    "paywall": ["subscribe to continue", "subscription required", "purchase a subscription"],
}
FRAMEWORKS = [
    ("mintlify", ["mintlify"]),
    ("nextjs", ["__next_data__", "/_next/static/", "next-router-state-tree", '"__n_e"', "self.__next_f.push"]),
    ("mkdocs", ["mkdocs", "md-content"]),
    ("vitepress", ["vitepress", "vp-doc"]),
    ("starlight", ["starlight", "sl-markdown-content"]),
    ("gitbook", ["gitbook", 'data-testid="page.content"']),
    ("readme", ["rm-markdown"]),
    ("api_reference", ["redoc", "scalar-api-reference"]),
    ("docusaurus", ["docusaurus"]),
    ("sphinx", ['name="generator" content="sphinx']),
]
AI_OPT_OUT = ["noai", "noimageai"]
NO_INDEX = ["noindex", "none"]
SKIPPED_LINKS = ["#", "javascript:", "mailto:", "tel:", "data:"]
#: An attribute before the one that is looked for, and a value in any of its three forms.
_BEFORE = r"""(?:[^\s"'>=]+\s*=\s*(?:"[^"]*"|'[^']*')\s*|[^\s"'>=]+(?:\s*=\s*[^\s"'>]+)?\s+)*?"""
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF = r"(?i)<a\s+" + _BEFORE + "href" + _VALUE
IMAGE = r"(?i)<img\s+" + _BEFORE + "src" + _VALUE
QUOTES = r"""^["']|["']$"""


def access_wall(page: Column) -> Column:
    """Kind of a short challenge, login or paywall response; null for others and beyond 50,000 characters."""
    text = F.lower(F.regexp_replace(page, r"\s+", " "))
    out = F.when(F.length(text) > 50_000, F.lit(None).cast("string"))
    for kind, markers in WALLS.items():
        out = out.when(any_of([text.contains(m) for m in markers]), kind)
    script = text.contains("enable javascript") & any_of([text.contains(m) for m in ("proceed", "continue", "challenge", "access")])
    return out.when(script, "bot_challenge")


def framework(page: Column, url: Column) -> Column:
    """The first documentation framework whose marker the page holds."""
    text, h = F.lower(page), host(url)
    hosts = {"readme": "readme.io"}
    out = None
    for name, markers in FRAMEWORKS:
        found = any_of([text.contains(m) for m in markers])
        if name in hosts:
            found = found | in_domain(h, hosts[name])
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.when(in_domain(h, "readthedocs.io"), "sphinx").otherwise("generic")


def visible_length(page: Column) -> Column:
    """Characters of the body's text nodes, each trimmed, without scripts and styles."""
    body = F.regexp_extract(F.regexp_replace(page, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>", ""), r"(?is)<body[^>]*>(.*)", 1)
    nodes = F.split(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "\u0001"), "\u0001")
    return F.aggregate(nodes, F.lit(0), lambda n, s: n + F.length(F.trim(s)))


def is_script_shell(page: Column, ratio: float = 0.05) -> Column:
    """A page of scripts with hardly any text of its own."""
    n = visible_length(page)
    return (F.length(page) >= 500) & F.lower(page).contains("<script") & (n < 500) & (n < ratio * F.length(page))


def is_loading_output(text: Column) -> Column:
    """Extracted text that is nothing but a placeholder."""
    body = F.trim(text)
    hits = F.regexp_count(body, F.lit(r"(?i)loading\.?\.?\.?|please wait|javascript required"))
    words = F.regexp_count(body, F.lit(r"\S+"))
    return (body == "") | ((F.length(body) <= 400) & ((hits >= 2) | ((hits >= 1) & (words < 20))))


def opt_out(content: Column, strict: bool = False) -> Column:
    """Sorted directives of a robots meta tag that forbid reuse; empty when it is allowed."""
    tokens = F.transform(F.filter(F.split(F.lower(content), r"[,\s]+"), lambda t: t != ""), lambda t: F.split_part(t, F.lit(":"), F.lit(1)))
    return F.array_sort(F.array_intersect(tokens, F.array(*map(F.lit, AI_OPT_OUT + NO_INDEX * strict))))


def attribute_values(page: Column, pattern: str) -> Column:
    """Values that HREF or IMAGE finds, in page order, without their quotes."""
    return F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)), lambda v: F.regexp_replace(v, QUOTES, ""))


def links(page: Column) -> Column:
    """href values of anchors in page order, duplicates kept, without those that lead nowhere."""
    return F.filter(attribute_values(page, HREF), lambda h: (h != "") & ~any_of([F.lower(h).startswith(s) for s in SKIPPED_LINKS]))


def resolved(href: Column, base: Column) -> Column:
    """An absolute link: absolute ones as they are, rooted ones on the base's host; no fragment."""
    bare = F.regexp_replace(href, "#.*$", "")
    return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(scheme(base), F.lit(":"), bare)).when(bare.startswith("/"), F.concat(scheme(base), F.lit("://"), netloc(base), bare)).otherwise(F.concat(F.regexp_extract(base, r"^([^?#]*/)", 1), bare))


def unescaped(text: Column) -> Column:
    """The five character references that HTML text needs, decoded; ampersands last."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def element_text(page: Column, tag: str) -> Column:
    """Text of the first element of this name, tags stripped, white space folded."""
    inner = F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(inner, "<[^>]*>", "")), r"\s+", " "))
