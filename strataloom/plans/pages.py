"""Queries over raw pages and their URLs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.functions import html as H
from strataloom.functions import urls as U
from strataloom.operators.corpus import numbered
from strataloom.plans.tables import quoted, sql_any, sql_built, sql_domain, sql_host, sql_list, sql_netloc, sql_path, sql_query, sql_scheme, sql_segments, table

ALLOWED, DENIED, DENIED_PATHS = ["example.com", "example.net"], ["m.example.com"], ["/fr/*", "/??/1*"]
START = "https://example.com/"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def url_normalize(spark, sf_dir):
    url = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.normalized(url).alias("norm_url"), U.canonical(url).alias("canonical_url"), U.host(url).alias("host"))


def seen_urls(spark, sf_dir):
    """The first page of each normalised URL."""
    return pages(spark, sf_dir).groupBy(U.normalized(F.col("url")).alias("norm_url")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


def url_policy_reason(spark, sf_dir):
    reason = U.policy_reason(F.col("url"), ALLOWED, DENIED, denied_paths=DENIED_PATHS)
    return pages(spark, sf_dir).select("page_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def glob_filter(spark, sf_dir):
    path = U.path(F.col("url"))
    return pages(spark, sf_dir).where(U.matches_glob(path, ["/en/*", "/de/*"]) & ~U.matches_glob(path, ["*/1??"])).select("page_id", path.alias("path"))


def crawl_hygiene(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", U.hygiene_reason(F.col("url"), START).alias("own"), U.locale_key(F.col("url")).alias("locale_key"), U.has_locale(F.col("url")).alias("localized"))
    first = rows.where("own is null").groupBy("locale_key").agg(F.min("page_id").alias("first_id"))
    joined = rows.join(first, "locale_key", "left")
    reason = F.coalesce("own", F.when(F.col("localized") & (F.col("page_id") > F.col("first_id")), "localized_duplicate"))
    return joined.select("page_id", "locale_key", reason.alias("reason"))


def domain_quota(spark, sf_dir):
    """The first three pages of each host."""
    rows = pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where("rn <= 3")


def domain_frequency(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(U.netloc(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def source_score(spark, sf_dir):
    title = H.element_text(F.col("html"), "title")
    score, reasons = U.source_score(F.col("url"), title, ALLOWED)
    return pages(spark, sf_dir).select("page_id", "url", score.cast("long").alias("score"), U.source_grade(score).alias("grade"), F.array_join(reasons, ",").alias("reasons"))


def source_ranking(spark, sf_dir):
    """Sources numbered by falling score, then URL."""
    score, _ = U.source_score(F.col("url"), F.lit(""), ALLOWED)
    return numbered(pages(spark, sf_dir).select("page_id", "url", score.alias("score")), F.col("score").desc(), F.col("url"), F.col("page_id")).select("page_id", F.col("score").cast("long"), "citation_id")


def page_role(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.page_role(F.col("url"), H.element_text(F.col("html"), "title")).alias("role"))


def public_urls(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", U.scrubbed(F.col("url")).alias("public_url"))


def markdown_alternates(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.explode(U.markdown_alternates(F.col("url"))).alias("alternate"))


def framework_detect(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.framework(F.col("html"), F.col("url")).alias("source_type"))


def access_wall(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.access_wall(F.col("html")).alias("category"))


def spa_html(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.visible_length(F.col("html")).cast("long").alias("text_len"), H.is_script_shell(F.col("html")).alias("is_spa"))


def page_metadata(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", H.element_text(F.col("html"), "title").alias("title"), H.element_text(F.col("html"), "h1").alias("h1"))


def _link_rows(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", "url", F.posexplode(H.links(F.col("html"))).alias("pos", "href"))
    return rows.withColumn("resolved", H.resolved(H.unescaped(F.col("href")), F.col("url")))


def link_extract(spark, sf_dir):
    rows = _link_rows(spark, sf_dir)
    return rows.select("page_id", F.col("pos").cast("long"), "href", "resolved")


def site_graph(spark, sf_dir):
    """Links between pages' hosts and where they lead, counted."""
    rows = _link_rows(spark, sf_dir)
    return rows.groupBy(U.host(F.col("url")).alias("from_host"), U.host(F.col("resolved")).alias("to_host")).agg(F.count("*").alias("links"), F.countDistinct("resolved").alias("targets"))


def image_candidates(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.explode(H.attribute_values(F.col("html"), H.IMAGE)).alias("src"))
    return rows.groupBy("src").agg(F.min("page_id").alias("page_id"))


def css_tokens(spark, sf_dir):
    """Declarations in style elements, ranked by use."""
    styles = pages(spark, sf_dir).select(F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))).alias("style"))
    rows = styles.select(F.explode(F.regexp_extract_all("style", F.lit(r"([a-z-]+:[^;{}]+)"), F.lit(1))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("uses"))


OPT_OUTS = [("a", "noai, noimageai"), ("b", "index, follow"), ("c", "NOINDEX max-snippet:0"), ("d", "none"), ("e", ""), ("f", "noai:1 other")]


def optout_meta(spark, sf_dir):
    rows = spark.createDataFrame(OPT_OUTS, "id string, content string")
    plain, strict = H.opt_out(F.col("content")), H.opt_out(F.col("content"), strict=True)
    return rows.select("id", (F.size(plain) > 0).alias("blocked"), F.array_join(strict, ",").alias("strict_matched"))


QUERIES = [url_normalize, seen_urls, url_policy_reason, glob_filter, crawl_hygiene, domain_quota, domain_frequency, source_score, source_ranking, page_role, public_urls, markdown_alternates, framework_detect, access_wall, spa_html, page_metadata, link_extract, site_graph, image_candidates, css_tokens, optout_meta]

_NORM = sql_built("url", sql_path("url"))
_TITLE = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<{t}\b[^>]*>(.*?)</{t}>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')
_DOMAIN = f"regexp_replace({sql_netloc('url')}, '^www\\.', '')"
_NEAR = "(" + " OR ".join(sql_domain("d", x) for x in ALLOWED) + ")"


def _score_sql(title: str) -> str:
    doc = " OR ".join(f"s = {quoted(t)} OR starts_with(s, {quoted(t + '-')}) OR starts_with(s, {quoted(t + '_')})" for t in U.DOC_TOKENS)
    rules = [
        (_NEAR, 20, "expected_domain"),
        (f"NOT {_NEAR}", -25, "off_domain"),
        ("starts_with(d, 'docs.') OR contains(d, '.docs.') OR starts_with(d, 'developer.') OR starts_with(d, 'developers.')", 12, "docs_domain"),
        (f"len(list_filter(parts, lambda s: {doc})) > 0", 10, "docs_path"),
        (" OR ".join(f"ends_with(p, {quoted(s)})" for s in U.SPEC_FILES), 15, "machine_readable_spec"),
        (sql_any("lower(t)", U.DOC_TITLE_TERMS), 8, "source_title"),
        (f"len(parts) = 1 AND list_contains({sql_list(U.LOCALES)}, parts[1])", -18, "locale_home_path"),
        (sql_any("p", U.LOW_PRIORITY_PARTS), -8, "lower_priority_path"),
        ("NOT starts_with(sc, 'http')", -15, "non_web_source"),
    ]
    total = " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n, _ in rules)
    reasons = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {quoted(r)} END" for c, _, r in rules) + "], lambda r: r IS NOT NULL)"
    return f"""s AS (SELECT page_id, url, {_DOMAIN} AS d, lower({sql_path('url')}) AS p, {sql_segments('url')} AS parts, {sql_scheme('url')} AS sc, {title} AS t FROM pages),
r AS (SELECT page_id, url, greatest(0, least(100, 50 + {total}))::BIGINT AS score, {reasons} AS reasons FROM s)"""


_ROLE_P = f"lower(CASE WHEN {sql_path('url')} = '' THEN '/' ELSE {sql_path('url')} END)"
_VALUES = lambda pattern: f"list_transform(regexp_extract_all(html, {quoted(pattern)}, 1), lambda v: regexp_replace(v, {quoted(H.QUOTES)}, '', 'g'))"
_LINKS = f"list_filter({_VALUES(H.HREF)}, lambda h: h <> '' AND NOT ({' OR '.join(f'starts_with(lower(h), {quoted(s)})' for s in H.SKIPPED_LINKS)}))"
_UNESC = "replace(replace(replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
_BARE = f"regexp_replace({_UNESC}, '#.*$', '')"
_RESOLVED = f"""CASE WHEN regexp_matches({_BARE}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {_BARE} WHEN starts_with({_BARE}, '//') THEN {sql_scheme('url')} || ':' || {_BARE}
  WHEN starts_with({_BARE}, '/') THEN {sql_scheme('url')} || '://' || {sql_netloc('url')} || {_BARE} ELSE regexp_extract(url, '^([^?#]*/)', 1) || {_BARE} END"""
_LINK_ROWS = f"links AS (SELECT page_id, url, pos - 1 AS pos, href FROM (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, url, {_LINKS} AS l FROM pages)))"
_LOW = "lower(regexp_replace(html, '\\s+', ' ', 'g'))"
_BODY = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(html, '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>', '', 'g'), '(?is)<body[^>]*>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(1), 'g')"
_LEN = f"coalesce(list_sum(list_transform(string_split({_BODY}, chr(1)), lambda s: length(trim(s)))), 0)::BIGINT"
_SUFFIX = f"lower(regexp_extract({sql_path('url')}, '[^/.](\\.[^./]+)/*$', 1))"
_OVERLAP = lambda words: f"list_has_any({sql_segments('url')}, {sql_list(words)})"
_LOCALE_PATH = f"('/' || array_to_string(list_filter(string_split({sql_path('url')}, '/'), lambda s: s <> '' AND NOT list_contains({sql_list(U.LOCALES)}, lower(s))), '/'))"
_MATCH = lambda text, globs: "(" + " OR ".join(f"regexp_matches({text}, {quoted(U.glob_pattern(g))})" for g in globs) + ")"
_POLICY_PATH = f"(CASE WHEN {sql_path('url')} = '' THEN '/' ELSE {sql_path('url')} END)"
_SCRUB = f"list_filter(string_split({sql_query('url')}, '&'), lambda q: q <> '' AND NOT list_contains({sql_list(U.SECRET_PARAMS)}, lower(split_part(q, '=', 1))))"
_PUBLIC = f"({sql_scheme('url')} || '://' || regexp_replace({sql_netloc('url')}, '^.*@', '') || {sql_path('url')})"
_ALT_BASE, _ALT_PATH = f"{sql_scheme('url')} || '://' || {sql_netloc('url')}", f"rtrim({sql_path('url')}, '/')"

SQL = {
    "url_normalize": f"SELECT page_id, {_NORM} AS norm_url, CASE WHEN {sql_scheme('url')} <> '' AND {sql_netloc('url')} <> '' THEN {sql_built('url', 'regexp_replace(' + sql_path('url') + chr(44) + quoted(';[^/]*$') + chr(44) + quoted('') + ')')} ELSE url END AS canonical_url, {sql_host('url')} AS host FROM pages",
    "seen_urls": f"SELECT {_NORM} AS norm_url, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1",
    "url_policy_reason": f"""WITH r AS (SELECT page_id, CASE WHEN NOT starts_with({sql_scheme('url')}, 'http') OR {sql_host('url')} = '' THEN 'not_http_url'
      WHEN NOT ({' OR '.join(sql_domain(sql_host('url'), d) for d in ALLOWED)}) THEN 'domain_not_allowed' WHEN {' OR '.join(sql_domain(sql_host('url'), d) for d in DENIED)} THEN 'domain_denied'
      WHEN {_MATCH(_POLICY_PATH, DENIED_PATHS)} THEN 'path_denied' END AS reason FROM pages) SELECT page_id, reason IS NULL AS allowed, reason FROM r""",
    "glob_filter": f"SELECT page_id, {sql_path('url')} AS path FROM pages WHERE {_MATCH(sql_path('url'), ['/en/*', '/de/*'])} AND NOT {_MATCH(sql_path('url'), ['*/1??'])}",
    "crawl_hygiene": f"""WITH r AS (SELECT page_id, CASE WHEN {sql_scheme('url')} NOT IN ('http', 'https') OR {sql_netloc('url')} = '' THEN 'invalid_url'
      WHEN list_contains({sql_list(U.DOWNLOAD_SUFFIXES)}, {_SUFFIX}) OR {_OVERLAP(['download', 'downloads'])} THEN 'binary_or_download'
      WHEN {_OVERLAP(U.LOW_VALUE_SEGMENTS)} AND {_NORM} <> {quoted(START)} THEN 'low_value_path' END AS own, {sql_built('url', _LOCALE_PATH)} AS locale_key, {_OVERLAP(U.LOCALES)} AS localized FROM pages),
      f AS (SELECT locale_key, min(page_id) AS first_id FROM r WHERE own IS NULL GROUP BY 1)
      SELECT page_id, r.locale_key, coalesce(own, CASE WHEN localized AND page_id > first_id THEN 'localized_duplicate' END) AS reason FROM r LEFT JOIN f ON f.locale_key = r.locale_key""",
    "domain_quota": f"SELECT page_id, host, rn FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM (SELECT page_id, {sql_host('url')} AS host FROM pages)) WHERE rn <= 3",
    "domain_frequency": f"SELECT {sql_netloc('url')} AS domain, count(*) AS n FROM pages GROUP BY 1",
    "source_score": f"WITH {_score_sql(_TITLE.format(t='title'))} SELECT page_id, url, score, CASE WHEN score >= 85 THEN 'primary' WHEN score >= 70 THEN 'strong' WHEN score >= 50 THEN 'usable' ELSE 'review' END AS grade, CASE WHEN len(reasons) = 0 THEN 'generic_web_source' ELSE array_to_string(reasons, ',') END AS reasons FROM r",
    "source_ranking": f"WITH {_score_sql(quoted(''))} SELECT page_id, score, 'S' || row_number() OVER (ORDER BY score DESC, url, page_id) AS citation_id FROM r",
    "page_role": f"WITH v AS (SELECT page_id, {_ROLE_P} AS p, {_ROLE_P} || ' ' || lower({_TITLE.format(t='title')}) AS value FROM pages) SELECT page_id, CASE WHEN p = '/' THEN 'home' {' '.join(f'WHEN {sql_any(chr(118) + chr(97) + chr(108) + chr(117) + chr(101), w)} THEN {quoted(r)}' for r, w in U.PAGE_ROLES.items())} ELSE 'other' END AS role FROM v",
    "public_urls": f"SELECT page_id, CASE WHEN len({_SCRUB}) = 0 THEN {_PUBLIC} ELSE {_PUBLIC} || '?' || array_to_string({_SCRUB}, '&') END AS public_url FROM pages",
    "markdown_alternates": f"SELECT page_id, unnest(CASE WHEN {_ALT_PATH} = '' THEN [{_ALT_BASE} || '/index.md'] ELSE [{_ALT_BASE} || {_ALT_PATH} || '.md', {_ALT_BASE} || {_ALT_PATH} || '/index.md'] END) AS alternate FROM pages",
    "framework_detect": "SELECT page_id, CASE " + " ".join(f"WHEN {sql_any('lower(html)', m)}{' OR ' + sql_domain(sql_host('url'), 'readme.io') if n == 'readme' else ''} THEN {quoted(n)}" for n, m in H.FRAMEWORKS) + f" WHEN {sql_domain(sql_host('url'), 'readthedocs.io')} THEN 'sphinx' ELSE 'generic' END AS source_type FROM pages",
    "access_wall": f"SELECT page_id, CASE WHEN length({_LOW}) > 50000 THEN NULL " + " ".join(f"WHEN {sql_any(_LOW, m)} THEN {quoted(k)}" for k, m in H.WALLS.items()) + f" WHEN contains({_LOW}, 'enable javascript') AND {sql_any(_LOW, ['proceed', 'continue', 'challenge', 'access'])} THEN 'bot_challenge' END AS category FROM pages",
    "spa_html": f"SELECT page_id, {_LEN} AS text_len, length(html) >= 500 AND contains(lower(html), '<script') AND {_LEN} < 500 AND {_LEN} < 0.05 * length(html) AS is_spa FROM pages",
    "page_metadata": f"SELECT page_id, {_TITLE.format(t='title')} AS title, {_TITLE.format(t='h1')} AS h1 FROM pages",
    "link_extract": f"WITH {_LINK_ROWS} SELECT page_id, pos, href, {_RESOLVED} AS resolved FROM links",
    "site_graph": f"WITH {_LINK_ROWS}, r AS (SELECT {sql_host('url')} AS from_host, {_RESOLVED} AS resolved FROM links) SELECT from_host, {sql_host('resolved')} AS to_host, count(*) AS links, count(DISTINCT resolved) AS targets FROM r GROUP BY 1, 2",
    "image_candidates": f"SELECT src, min(page_id) AS page_id FROM (SELECT page_id, unnest({_VALUES(H.IMAGE)}) AS src FROM pages) GROUP BY src",
    "css_tokens": "SELECT token, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(style, '([a-z-]+:[^;{}]+)', 1)) AS token FROM (SELECT unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)) AS style FROM pages)) GROUP BY token",
    "optout_meta": "WITH v(id, content) AS (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in OPT_OUTS) + "), t AS (SELECT id, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(content), '[,\\s]+'), lambda x: x <> ''), lambda x: split_part(x, ':', 1))) AS d FROM v) SELECT id, list_has_any(d, ['noai', 'noimageai']) AS blocked, array_to_string(list_sort(list_intersect(d, ['noai', 'noimageai', 'noindex', 'none'])), ',') AS strict_matched FROM t",
}
