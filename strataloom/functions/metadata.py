"""Metadata that pages declare: OpenGraph, JSON-LD and microdata, without a parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.text import unescaped

_ATTRIBUTE = r"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: OpenGraph names and the fields that they fill.
OPENGRAPH = {
    "title": "title", "description": "description", "image": "image", "type": "type", "site_name": "site_name", "canonical_url": "url", "author": "article:author",
    "published_time": "article:published_time", "modified_time": "article:modified_time", "section": "article:section",
}
FIELDS = (*OPENGRAPH, "tags", "keywords")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag's text, references decoded; null if the tag has none."""
    pattern = _ATTRIBUTE.format(name=name)
    found = F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))
    return F.when(tag.rlike(pattern), unescaped(found))


def _first(values: Column) -> Column:
    """The first value that is not empty, else an empty one if there is any, else null."""
    return F.coalesce(F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1)), F.try_element_at(values, F.lit(1)))


def _opengraph(html: Column) -> dict[str, Column]:
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1))
    named = F.transform(tags, lambda t: F.struct(F.regexp_replace(F.coalesce(attribute(t, "property"), attribute(t, "name"), F.lit("")), "^og:", "").alias("name"), F.coalesce(attribute(t, "property"), F.lit("")).rlike("^(og|article):").alias("og"), F.trim(F.coalesce(attribute(t, "content"), F.lit(""))).alias("content")))
    own = F.filter(named, lambda m: m["og"])
    value = lambda name: F.transform(F.filter(own, lambda m: m["name"] == name), lambda m: m["content"])
    out = {field: F.try_element_at(value(name), F.lit(1)) for field, name in OPENGRAPH.items()}
    return out | {"tags": F.nullif(value("article:tag"), F.array().cast("array<string>"))}


def _text_of(value: Column) -> Column:
    """A JSON value as text: the first of a list, nothing for null and for objects."""
    plain = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT") | F.is_variant_null(v), "").otherwise(F.trim(F.try_variant_get(v, "$", "string")))
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when(items.isNotNull(), F.coalesce(plain(F.try_element_at(items, F.lit(1))), F.lit(""))).otherwise(plain(value))


def _json_ld(html: Column) -> dict[str, Column]:
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""), F.lit(1))
    parsed = F.transform(scripts, lambda s: F.try_parse_json(F.trim(s)))
    one_or_more = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    things = F.filter(F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), one_or_more)), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    members = F.transform(things, lambda v: F.try_variant_get(v, "$", "map<string,variant>"))
    held = lambda name: F.transform(F.filter(members, lambda m: F.array_contains(F.map_keys(m), name)), lambda m: F.try_element_at(m, F.lit(name)))

    def inner(name: str, member: str) -> Column:
        """Texts, and of objects the member's text; values of other kinds are none."""
        def text(v: Column) -> Column:
            kind = F.schema_of_variant(v)
            of_object = F.coalesce(_text_of(F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(member))), F.lit(""))
            return F.when(kind.startswith("OBJECT"), of_object).when(kind == "STRING", _text_of(v))

        return F.filter(F.transform(held(name), text), lambda x: x.isNotNull())

    def words(v: Column) -> Column:
        listed = F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda k: ~F.is_variant_null(k)), _text_of)
        parted = F.filter(F.transform(F.split(F.try_variant_get(v, "$", "string"), ","), lambda k: F.trim(k)), lambda k: k != "")
        return F.when(F.schema_of_variant(v) == "STRING", parted).otherwise(listed)

    keywords = F.filter(F.transform(held("keywords"), words), lambda k: k.isNotNull())
    plain = {"title": "headline", "description": "description", "published_time": "datePublished", "modified_time": "dateModified"}
    out = {field: _first(F.transform(held(name), _text_of)) for field, name in plain.items()}
    full = F.filter(keywords, lambda k: F.size(k) > 0)
    return out | {"author": _first(inner("author", "name")), "image": _first(inner("image", "url")), "keywords": F.try_element_at(full, F.lit(1))}


def _microdata(html: Column) -> dict[str, Column]:
    """Properties of items: a ``content`` attribute, else the element's text up to its next closing tag; of an author that is an item, its name."""
    scoped = F.regexp_extract(html, r"(?is)(<[^>]*\sitemscope\b.*)", 1)

    def value(name: str) -> Column:
        tag = F.regexp_extract(scoped, rf"""(?is)(<[a-z][^>]*\sitemprop\s*=\s*["']?{name}["']?(?=[\s>/])[^>]*>)""", 1)
        rest = F.substring_index(F.substr(scoped, F.instr(scoped, tag) + F.length(tag)), "</", 1)
        text = F.btrim(F.regexp_replace(unescaped(F.regexp_replace(rest, "<[^>]*>", "")), r"\s+", " "))
        return F.when(tag != "", F.coalesce(F.trim(attribute(tag, "content")), text)), tag

    author, tag = value("author")
    name, _ = value("name")
    author = F.when(tag.rlike(r"(?i)\sitemscope\b"), F.coalesce(name, F.lit(""))).otherwise(author)
    return {"title": value("headline")[0], "description": value("description")[0], "author": author}


def rich_metadata(html: Column, fallback_title: Column | None = None) -> dict[str, Column]:
    """A column for each of ``FIELDS``: what microdata says, else JSON-LD, else OpenGraph; null where nothing or an empty text is said.

    Of several things in JSON-LD the first that says something counts.  ``keywords`` and ``tags`` are arrays.
    ``fallback_title`` stands in for a missing title.
    """
    sources = [_microdata(html), _json_ld(html), _opengraph(html)]
    out = {}
    for field in FIELDS:
        said = F.coalesce(*(s[field] for s in sources if field in s))
        out[field] = said if field in ("tags", "keywords") else F.nullif(said, F.lit(""))
    if fallback_title is not None:
        out["title"] = F.coalesce(out["title"], F.nullif(fallback_title, F.lit("")))
    return out
