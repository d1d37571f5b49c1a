"""Lexical, BM25, vector and line search over corpora, and what is cited from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.functions import text as T
from strataloom.lineage import cut


def lexical_score(terms: Sequence[str], phrase: str, title: Column, heading: Column, url: Column, content: Column) -> tuple[Column, Column]:
    """(score, matched terms): capped hits by field, a bonus for the phrase and for several terms.

    The fields come folded and cleaned, as columns, since every term reads them again.
    """
    fields = [(title, 3, 8, 20), (heading, 3, 6, 14), (url, 3, 3, 0), (content, 10, 2, 10)]
    score, matched = F.lit(0), []
    for term in sorted(set(terms)):
        hits = [F.when(F.contains(f, F.lit(term)), T.term_count(f, term)).otherwise(0) for f, _, _, _ in fields]
        score = reduce(lambda a, x: a + F.least(x[0], F.lit(x[1][1])) * x[1][2], zip(hits, fields, strict=True), score)
        matched.append(F.when(reduce(lambda a, b: a + b, hits) > 0, F.lit(term)))
    if len(phrase) >= 4:
        score = reduce(lambda a, f: a + F.when(f[0].contains(phrase), f[3]).otherwise(0), fields, score)
    found = F.array_compact(F.array(*matched))
    return score + F.when(F.size(found) > 1, F.size(found) * 3).otherwise(0), found


def lexical_search(records: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The ``k`` best records for a query: rank, doc_id, score, terms and excerpt."""
    phrase = query.strip().lower()
    terms = sorted({w for w in phrase.split() if len(w) >= 3})
    folded = {c: F.lower(T.clean_passage(F.col(c))) for c in ("title", "content")}
    # cleaning joins letters only over backticks and links; texts with neither, and no word of the query, score nothing
    signs = [F.contains(F.col(c), F.lit(sign)) for c in ("title", "content") for sign in ("`", "](")]
    words = [F.contains(F.lower(c), F.lit(w)) for c in ("title", "url", "content") for w in {*terms, phrase} if w]
    held = records.where(reduce(lambda a, b: a | b, [*words, *signs]))
    fields = F.struct(folded["title"].alias("title"), F.lower("url").alias("url"), folded["content"].alias("content"))

    def scored(f: Column) -> Column:
        score, found = lexical_score(terms, phrase, f["title"], F.lit(""), f["url"], f["content"])
        return F.struct(score.cast("long").alias("score"), found.alias("terms"))

    # within a function on an array of one, fields are made once, however often the score names them
    hits = held.select("doc_id", "url", "content", F.get(F.transform(F.array(fields), scored), F.lit(0)).alias("_hit"))
    hits = hits.select("doc_id", "url", "_hit.score", "_hit.terms", "content").where("score > 0")
    best = hits.orderBy(F.col("score").desc(), "url").limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "url")))
    return ranked.select("rank", "doc_id", "score", "terms", T.excerpt(T.clean_passage(F.col("content")), [*terms, phrase]).alias("excerpt"))


def postings(records: DataFrame) -> DataFrame:
    """(term, doc_id, tf): the inverted index."""
    words = records.select("doc_id", F.explode(T.keywords(F.col("content"))).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def bm25(records: DataFrame, terms: Sequence[str], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents by BM25.

    Only the query's terms are counted, in one pass over the text, with the lengths.
    """
    frequency = lambda term: F.size(F.filter("words", lambda w: w == term))
    worded = records.select("doc_id", T.keywords(F.col("content")).alias("words"))
    counted = cut(worded.select("doc_id", F.size("words").alias("dl"), *[frequency(t).alias(f"t{i}") for i, t in enumerate(terms)]))
    shape = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.when(F.col(f"t{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))])
    # one row
    joined = counted.join(F.broadcast(shape))
    norm = F.lit(k1) * (1 - b + b * F.col("dl") / F.col("avgdl"))
    parts = [F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + norm) for i in range(len(terms))]
    scored = joined.select("doc_id", F.round(reduce(lambda x, y: x + y, parts), 6).alias("bm25"))
    return scored.where("bm25 > 0").orderBy(F.col("bm25").desc(), "doc_id").limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, least: float = -1.0) -> DataFrame:
    """The ``k`` most similar vectors; those under ``least`` go after the cut to ``k``."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", "label", F.round(cosine(F.col("embedding"), literal), 6).alias("similarity"))
    best = scored.orderBy(F.col("similarity").desc(), "vec_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "vec_id"))).where(F.col("similarity") >= least)


def grep(records: DataFrame, pattern: str, around: int = 1) -> DataFrame:
    """Matching lines with those around them: doc_id, line_no, line, before, after."""
    lines = F.split("content", "\n")
    hits = records.select("doc_id", lines.alias("lines"), F.posexplode(lines).alias("i", "line")).where(F.col("line").rlike(pattern))
    before = F.slice("lines", F.greatest(F.lit(1), F.col("i") + 1 - around), F.least(F.lit(around), F.col("i")))
    return hits.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line", F.array_join(before, "\n").alias("before"), F.array_join(F.slice("lines", F.col("i") + 2, F.lit(around)), "\n").alias("after"))


def grep_ranked(records: DataFrame, pattern: str) -> DataFrame:
    """Matching lines per document."""
    n = F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(pattern))).cast("long")
    return records.select("doc_id", n.alias("matches")).where("matches > 0")


def line_slice(records: DataFrame, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last``, counted from 1, of every record."""
    return records.select("doc_id", F.array_join(F.slice(F.split("content", "\n"), first, last - first + 1), "\n").alias("text"))


def locate_passages(records: DataFrame, passages: DataFrame, grams: int = 8) -> DataFrame:
    """Where passages occur word for word: item_id, doc_id, char_start, char_end and the span's digest.

    Candidates share the passage's rarest window of words, so each passage meets only
    the documents that hold that window, and ``instr`` confirms them.  Passages of fewer
    words than a window use all their words.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    window = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " "))
    items = passages.select("item_id", F.trim("text").alias("passage"), words(F.trim("text")).alias("w")).where(F.size("w") > 0)
    # the first and last word may be parts of longer words in a document, so windows leave them out
    inner = F.when(F.size("w") > 2, F.slice("w", F.lit(2), F.size("w") - 2)).otherwise(F.array())
    items = items.withColumn("w", inner).withColumn("n", F.least(F.size("w"), F.lit(grams)))
    sizes = sorted(r[0] for r in items.select("n").distinct().collect())
    found = None
    for n in sizes:
        own = items.where(F.col("n") == n)
        if n == 0:
            # too short for windows: compared with every record, a bounded set of passages
            near = records.select("doc_id", "content").join(F.broadcast(own), F.expr("instr(content, passage) > 0"))
        else:
            keys = own.select("item_id", "passage", window(F.col("w"), F.lit(0), n).alias("key"))
            rows = records.select("doc_id", "content", words(F.col("content")).alias("w"))
            # distinct windows of each record; only those of passages pass the join
            grams_of = rows.select("doc_id", F.explode(F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: i + n <= F.size("w")), lambda i: window(F.col("w"), i, n)))).alias("key"))
            pairs = grams_of.join(keys, "key").select("doc_id", "item_id", "passage").distinct()
            near = records.select("doc_id", "content").join(pairs, "doc_id")
        found = near.select("item_id", "doc_id", "passage", "content") if found is None else found.unionByName(near.select("item_id", "doc_id", "passage", "content"))
    at = F.expr("instr(content, passage)") - 1
    return found.where("instr(content, passage) > 0").select("item_id", "doc_id", at.cast("long").alias("char_start"), (at + F.length("passage")).cast("long").alias("char_end"), F.sha2("passage", 256).alias("sha"))
