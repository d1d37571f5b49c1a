"""What sites' robots files and response headers allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Directives that carry a value after a colon.
VALUED_DIRECTIVES = ["max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"]
RULES = ["allow", "disallow", "crawl-delay", "request-rate"]


def robots_lines(files: DataFrame) -> DataFrame:
    """``files`` (host, body) as (host, pos, field, value, part): a part is a run of agents and its rules.

    A blank line, or an agent after a rule, begins a part; comments and unknown fields are left out.
    """
    bare = F.trim(F.regexp_replace("line", "#.*", ""))
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    fields = lines.select("host", "pos", (F.trim("line") == "").alias("blank"), F.lower(F.trim(F.split_part(bare, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("value"))
    kept = fields.where(F.col("blank") | F.col("field").isin("user-agent", "sitemap", *RULES))
    order = Window.partitionBy("host").orderBy("pos")
    before = F.last(F.when(F.col("field") != "sitemap", F.col("field")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("blank") | ((F.col("field") == "user-agent") & (F.coalesce(before, F.lit("")) != "user-agent"))
    return kept.withColumn("part", F.sum(starts.cast("int")).over(order)).where("not blank").drop("blank")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, rules, crawl_delay, sitemaps): the rules in order of the part that applies to ``agent``.

    A part that names the agent goes before one for all; of several, the first applies.
    """
    lines = robots_lines(files)
    value, name = F.lower("value"), F.lit(agent.lower())
    parts = lines.groupBy("host", "part").agg(
        F.max(((F.col("field") == "user-agent") & (F.col("value") == "*")).cast("int")).alias("for_all"),
        F.max((F.col("field") == "user-agent") & (F.col("value") != "") & name.contains(value)).alias("named"),
        F.max(F.col("field").isin(RULES)).alias("ruled"),
        F.array_sort(F.collect_list(F.when(F.col("field").isin("allow", "disallow"), F.struct("pos", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("path"))))).alias("rules"),
        F.max_by("value", F.when(F.col("field") == "crawl-delay", F.col("pos"))).try_cast("double").alias("delay"),
    )
    fit = F.when(F.col("ruled") & (F.col("named") | (F.col("for_all") == 1)), F.struct("for_all", "part"))
    best = parts.groupBy("host").agg(F.min_by("rules", fit).alias("rules"), F.min_by("delay", fit).alias("crawl_delay"))
    maps = lines.where("field = 'sitemap'").groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("sitemaps"))
    return best.join(maps, "host", "left").withColumn("sitemaps", F.coalesce("sitemaps", F.array().cast("array<string>")))


def allowed(rules: Column, path: Column) -> Column:
    """The first rule whose path begins the url's path decides; without one, or a file, it is allowed."""
    fitting = F.filter(rules, lambda r: (r["path"] == "*") | path.startswith(r["path"]))
    return F.coalesce(F.get(fitting, 0)["allow"], F.lit(True))


def header_directives(value: Column, agent: str) -> Column:
    """Sorted directives of an X-Robots-Tag header for all agents or for ``agent``.

    A name before a colon limits its token and all after it to that agent, until the next name.
    """
    none = F.lit(None).cast("string")
    tokens = F.filter(F.transform(F.split(value, ","), F.trim), lambda t: t != "")
    start = F.struct(none.alias("scope"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, token: Column) -> Column:
        prefix = F.lower(F.trim(F.split_part(token, F.lit(":"), F.lit(1))))
        names = token.contains(":") & ~prefix.isin(VALUED_DIRECTIVES)
        scope = F.when(names, prefix).otherwise(state["scope"])
        rest = F.when(names, F.trim(F.regexp_extract(token, "^[^:]*:(.*)$", 1))).otherwise(token)
        words = F.filter(F.split(F.lower(F.split_part(rest, F.lit(":"), F.lit(1))), r"\s+"), lambda w: w != "")
        mine = scope.isNull() | (scope == agent.lower())
        return F.struct(scope.alias("scope"), F.concat(state["found"], F.when(mine, words).otherwise(F.array().cast("array<string>"))).alias("found"))

    return F.aggregate(tokens, start, step, lambda s: F.array_sort(F.array_distinct(s["found"])))
