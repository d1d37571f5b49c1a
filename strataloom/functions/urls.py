"""Column functions over URLs.

All take and return columns, never throw on malformed input and keep to built-in
expressions, so they stay inside generated code and can be pushed past joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
HOST = r"^(?:.*@)?([^:]*)"

# Names that the rules below look for.
DOWNLOAD_SUFFIXES = ".7z .avi .bin .bz2 .csv .dmg .doc .docx .exe .gif .gz .ico .iso .jpeg .jpg .mov .mp3 .mp4 .pdf .png .ppt .pptx .tar .tgz .webm .webp .xls .xlsx .zip".split()
LOW_VALUE_SEGMENTS = "account app dashboard login pricing sign-in sign-up signin signup".split()
LOCALES = "ar bg bn ca cs da de el en es fa fi fr he hi id it ja ko nl no pl pt pt-br ro ru sv th tr uk vi zh zh-cn zh-hans zh-hant zh-tw".split()
DOC_TOKENS = "docs api reference developers tutorial guide guides learn how-to manual examples quickstart".split()
DOC_TITLE_TERMS = "docs documentation api reference changelog tutorial guide quickstart manual".split()
LOW_PRIORITY_PARTS = "/blog /news /newsletter /press /legal /privacy /terms /login /signup /sign-in /sign-up /account /sponsor /sponsors".split()
SPEC_FILES = "llms.txt openapi.json swagger.json openapi.yaml openapi.yml".split()
PAGE_ROLES = {
    "pricing": ["pricing", "plans", "billing"],
    "documentation": ["/docs", "documentation", "api reference", "developer"],
    "trust": ["security", "trust", "compliance", "soc 2", "subprocessor"],
    "legal": ["privacy", "terms", "legal", "cookie", "dpa"],
    "changelog": ["changelog", "release-notes", "release notes", "updates"],
    "support": ["support", "help", "contact"],
    "product": ["product", "products", "solution", "features", "platform"],
}
SECRET_PARAMS = "token key api_key apikey access_token secret password signature sig auth".split()


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, NETLOC, 1))


def host(url: Column) -> Column:
    """Host without user and port."""
    return F.regexp_extract(netloc(url), HOST, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def segments(url: Column) -> Column:
    """Non-empty path segments, in lower case."""
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def _built(url: Column, of_path: Column) -> Column:
    bare = F.rtrim(of_path, F.lit("/"))
    tail = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.when(bare == "", "/").otherwise(bare), tail)


def normalized(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash but the root's, no fragment, query kept."""
    return _built(url, path(url))


def canonical(url: Column) -> Column:
    """As ``normalized``, without ``;params``; a URL without scheme or host stays as it is."""
    absolute = (scheme(url) != "") & (netloc(url) != "")
    return F.when(absolute, _built(url, F.regexp_replace(path(url), ";[^/]*$", ""))).otherwise(url)


def locale_key(url: Column) -> Column:
    """Normalised URL without its locale segments."""
    kept = F.filter(F.split(path(url), "/"), lambda s: (s != "") & ~F.lower(s).isin(LOCALES))
    return _built(url, F.concat(F.lit("/"), F.array_join(kept, "/")))


def has_locale(url: Column) -> Column:
    return F.arrays_overlap(segments(url), F.array(*map(F.lit, LOCALES)))


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored regular expression that Java and RE2 read alike."""
    named = {"*": ".*", "?": "."}
    return "^" + "".join(named.get(c, c if c.isalnum() or c in "/_-" else "\\" + c) for c in glob) + "$"


def matches_glob(text: Column, globs: Sequence[str]) -> Column:
    return any_of([text.rlike(glob_pattern(g)) for g in globs])


def in_domain(of_host: Column, domain: str) -> Column:
    """Exact host or one below it; a leading ``*.`` means the same."""
    bare = domain.removeprefix("*.").lower()
    return (of_host == bare) | of_host.endswith("." + bare)


def policy_reason(url: Column, allowed: Sequence[str] = (), denied: Sequence[str] = (), allowed_paths: Sequence[str] = (), denied_paths: Sequence[str] = ()) -> Column:
    """Why a source policy refuses a URL; null when it allows it.  The checks are in order."""
    h, p = F.rtrim(host(url), F.lit(".")), F.when(path(url) == "", "/").otherwise(path(url))
    checks = [(~scheme(url).startswith("http") | (h == ""), "not_http_url")]
    if allowed:
        checks.append((~any_of([in_domain(h, d) for d in allowed]), "domain_not_allowed"))
    if denied:
        checks.append((any_of([in_domain(h, d) for d in denied]), "domain_denied"))
    if allowed_paths:
        checks.append((~matches_glob(p, allowed_paths), "path_not_allowed"))
    if denied_paths:
        checks.append((matches_glob(p, denied_paths), "path_denied"))
    out = F.when(checks[0][0], checks[0][1])
    for condition, reason in checks[1:]:
        out = out.when(condition, reason)
    return out


def hygiene_reason(url: Column, start: str) -> Column:
    """Why a crawl from ``start`` skips a URL by itself; locale duplicates need the other URLs."""
    suffix = F.lower(F.regexp_extract(path(url), r"[^/.](\.[^./]+)/*$", 1))
    download = suffix.isin(DOWNLOAD_SUFFIXES) | F.arrays_overlap(segments(url), F.array(F.lit("download"), F.lit("downloads")))
    low = F.arrays_overlap(segments(url), F.array(*map(F.lit, LOW_VALUE_SEGMENTS))) & (normalized(url) != normalized(F.lit(start)))
    return F.when(~scheme(url).isin("http", "https") | (netloc(url) == ""), "invalid_url").when(download, "binary_or_download").when(low, "low_value_path")


def source_score(url: Column, title: Column, expected: Sequence[str] = ()) -> tuple[Column, Column]:
    """(score, reasons) of a source: 50, changed by what its URL and title show, within 0 to 100."""
    domain = F.regexp_replace(netloc(url), r"^www\.", "")
    p, parts = F.lower(path(url)), segments(url)
    rules: list[tuple[Column, int, str]] = []
    if expected:
        near = any_of([in_domain(domain, d.lower().removeprefix("www.")) for d in expected])
        rules += [(near, 20, "expected_domain"), (~near, -25, "off_domain")]
    doc_part = F.exists(parts, lambda s: any_of([(s == t) | s.startswith(t + "-") | s.startswith(t + "_") for t in DOC_TOKENS]))
    rules += [
        (domain.startswith("docs.") | domain.contains(".docs.") | domain.startswith("developer.") | domain.startswith("developers."), 12, "docs_domain"),
        (doc_part, 10, "docs_path"),
        (any_of([p.endswith(s) for s in SPEC_FILES]), 15, "machine_readable_spec"),
        (any_of([F.lower(title).contains(t) for t in DOC_TITLE_TERMS]), 8, "source_title"),
        ((F.size(parts) == 1) & F.get(parts, F.lit(0)).isin(LOCALES), -18, "locale_home_path"),
        (any_of([p.contains(t) for t in LOW_PRIORITY_PARTS]), -8, "lower_priority_path"),
        (~scheme(url).startswith("http"), -15, "non_web_source"),
    ]
    total = reduce(lambda a, r: a + F.when(F.coalesce(r[0], F.lit(False)), r[1]).otherwise(0), rules, F.lit(50))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, _, name in rules]))
    return F.greatest(F.lit(0), F.least(F.lit(100), total)), F.when(F.size(reasons) == 0, F.array(F.lit("generic_web_source"))).otherwise(reasons)


def source_grade(score: Column) -> Column:
    return F.when(score >= 85, "primary").when(score >= 70, "strong").when(score >= 50, "usable").otherwise("review")


def page_role(url: Column, title: Column) -> Column:
    """The first role whose keywords the path or title holds."""
    p = F.lower(F.when(path(url) == "", "/").otherwise(path(url)))
    value = F.concat(p, F.lit(" "), F.lower(F.coalesce(title, F.lit(""))))
    out = F.when(p == "/", "home")
    for role, words in PAGE_ROLES.items():
        out = out.when(any_of([value.contains(w) for w in words]), role)
    return out.otherwise("other")


def scrubbed(url: Column) -> Column:
    """A URL fit for publication: no user part and no parameters that look like secrets."""
    kept = F.filter(F.split(query(url), "&"), lambda q: (q != "") & ~F.lower(F.split_part(q, F.lit("="), F.lit(1))).isin(SECRET_PARAMS))
    bare = F.concat(scheme(url), F.lit("://"), F.regexp_replace(netloc(url), "^.*@", ""), path(url))
    return F.when(F.size(kept) == 0, bare).otherwise(F.concat(bare, F.lit("?"), F.array_join(kept, "&")))


def markdown_alternates(url: Column) -> Column:
    """URLs under which a site may offer the page as Markdown."""
    base = F.concat(scheme(url), F.lit("://"), netloc(url))
    p = F.rtrim(path(url), F.lit("/"))
    return F.when(p == "", F.array(F.concat(base, F.lit("/index.md")))).otherwise(F.array(F.concat(base, p, F.lit(".md")), F.concat(base, p, F.lit("/index.md"))))
