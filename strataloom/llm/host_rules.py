"""Quality rules with host-level verdicts, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import cut, join_sized

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Bits of a packed key that hold a window's place.  The other 48 are of its hash, and
#: longer texts sort structs with all 64, so both find the same windows.
PLACE_BITS = 16


def _repeat_words(words: Column, keys: Column, hashed: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
    """Words that lie in a window which another window of the text equals.

    ``keys`` hold hash and place of each window, sorted, so equal windows are neighbours;
    the words themselves confirm that neighbours are equal.
    """
    window = lambda key: F.slice(words, place(key) + 1, 3)

    def same(i: Column, j: Column) -> Column:
        a, b = F.get(keys, i), F.get(keys, j)
        return F.when((j >= 0) & (j < F.size(keys)) & (hashed(a) == hashed(b)), window(a) == window(b)).otherwise(F.lit(False))

    places = F.array_sort(F.transform(F.filter(keys, lambda key, i: same(i, i - 1) | same(i, i + 1)), place))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")),
        lambda acc: acc["n"].cast("bigint"),
    )


def text_figures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A null text counts as empty; all figures are then zero.  Other columns are left out.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    ink = lambda s: F.regexp_replace(s, SPACES, "")
    base = docs.select(
        *keep,
        F.length(ink(whole)).cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
        F.filter(F.split(whole, SPACES, -1), lambda w: w != "").alias("_words"),
    )
    counted = base.select(
        "*",
        F.size("_words").cast("bigint").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    ).drop("_lines")
    short = F.col("n_words") <= 1 << PLACE_BITS
    firsts = F.slice(F.col("_hashes"), F.lit(1), F.greatest(F.size("_hashes") - 2, F.lit(0)))
    window = lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    packed = F.transform(firsts, lambda h, i: F.shiftleft(window(h, i), PLACE_BITS).bitwiseOR(i.cast("bigint")))
    whole_keys = F.transform(firsts, lambda h, i: F.struct(window(h, i).alias("h"), i.alias("i")))
    keyed = counted.select("*", F.when(short, F.sort_array(packed)).alias("_packed"), F.when(~short, F.sort_array(whole_keys)).alias("_keys")).drop("_hashes")
    low = F.lit((1 << PLACE_BITS) - 1)
    few = _repeat_words(F.col("_words"), F.col("_packed"), lambda key: F.shiftright(key, PLACE_BITS), lambda key: key.bitwiseAND(low).cast("int"))
    many = _repeat_words(F.col("_words"), F.col("_keys"), lambda key: key["h"], lambda key: key["i"])
    return keyed.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(short, few).otherwise(many).alias("n_repeat_words"))


def host_verdicts(figures: DataFrame, host: str = "source", failed: str = "base_failed", max_rate: float = 0.5) -> DataFrame:
    """One row per host: n_docs, n_failed, the shrunk failure rate and ``host_ok``.

    The beta prior is fitted to the hosts' own rates by the method of moments and has
    the weight of at least one document.  A host is refused when its shrunk rate
    exceeds ``max_rate``.  A null host is a host of its own.
    """
    hosts = figures.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("spread"),
        F.avg(1 / F.col("n_docs")).alias("per_doc"),
    )
    noise = F.col("mean") * (1 - F.col("mean"))
    between = F.greatest(F.col("spread") - noise * F.col("per_doc"), noise * F.lit(1e-3))
    strength = F.when(noise > 0, F.greatest(noise / between - 1, F.lit(1.0))).otherwise(F.lit(1.0))
    prior = prior.select("mean", strength.alias("strength"))
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    # the prior is one row, an ungrouped aggregate
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("rate")).withColumn("host_ok", F.col("rate") <= max_rate)


def apply_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_rate: float = 0.5,
) -> DataFrame:
    """Every document's key, host, figures, own verdict ``base_failed`` and ``kept`` after its host's.

    An empty or null text has no words and fails.  Documents of a null host are judged
    together.  An empty table gives an empty result; repeated rows are kept and counted, and
    columns other than the key, text and host play no part, whatever their names.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    figures = cut(text_figures(docs, [key, host], text).withColumn("base_failed", failed))
    # a struct is a key that is not null even where the host is
    whose = F.struct(F.col(host).alias("host")).alias("_host")
    verdicts = host_verdicts(figures, host, max_rate=max_rate)
    verdicts = cut(verdicts.select(F.struct("host").alias("_host"), "host_ok", F.col("n_docs").alias("size")))
    joined = join_sized(figures.select("*", whose), verdicts, "_host", 256)
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("_host", "host_ok", "size")
