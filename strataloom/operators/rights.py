"""What may be done with records: a lattice of permissions, met over packs and along derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.lineage import cut

USES = ("internal_indexing", "redistribution", "model_training", "eval_generation")
#: Spellings of each status; all others are unknown.
ALLOWED = ["allowed", "permitted", "yes", "true"]
CONDITIONAL = ["allowed_with_conditions", "conditional", "conditioned", "permitted_with_conditions"]
DENIED = ["denied", "disallowed", "no", "false"]
#: A status as bits, so that "or" is the meet: what is denied anywhere is denied, conditions hold on, unknown adds nothing.
_BITS = {"allowed": 1, "allowed_with_conditions": 2, "denied": 4}
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
SENSITIVE = r"(?i)\b(?:api[_ -]?key|secret|password|private[_ -]?key|bearer\s+[A-Za-z0-9._-]+|ssn)\b"


def status(value: Column) -> Column:
    """allowed, allowed_with_conditions, denied or unknown for whatever spelling of it."""
    name = F.translate(F.lower(F.trim(value.cast("string"))), "- ", "__")
    return F.when(name.isin(ALLOWED), "allowed").when(name.isin(CONDITIONAL), "allowed_with_conditions").when(name.isin(DENIED), "denied").otherwise("unknown")


def status_bits(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in _BITS.items() for x in pair])
    return F.coalesce(known[status(value)], F.lit(0))


def status_of_bits(bits: Column) -> Column:
    has = lambda bit: F.coalesce(bits, F.lit(0)).bitwiseAND(bit) > 0
    return F.when(has(4), "denied").when(has(2), "allowed_with_conditions").when(has(1), "allowed").otherwise("unknown")


def met(value: Column) -> Column:
    """The meet of statuses over a group, an aggregate that combines before any shuffle."""
    return status_of_bits(F.bit_or(status_bits(value)))


def rights_manifest(records: DataFrame, by: str, explicit: DataFrame | None = None) -> DataFrame:
    """One row for each pack: its permitted uses, whether there are any, obligations, hosts, license hints and risks.

    ``records`` have ``by``, ``content``, ``license_hint``, ``host``, the ``USES`` and ``obligations``, an array.  ``explicit``
    are rows (by, the USES, obligations) of what packs say themselves: where a pack says anything of
    uses, its records' statuses do not count; its obligations are added to theirs.  Blank hints, hosts and
    obligations are none; risks are told from all contents, not a sample.
    """
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    own = [F.bit_or(status_bits(F.col(use))).alias(use) for use in USES]
    risks = [F.coalesce(F.bool_or(F.col("content").rlike(pattern)), F.lit(False)).alias(name) for name, pattern in (("pii", EMAIL), ("sensitive", SENSITIVE))]
    sets = [F.array_sort(F.collect_set(text("host"))).alias("source_domains"), F.array_sort(F.collect_set(text("license_hint"))).alias("license_hints")]
    packs = records.groupBy(by).agg(*own, *risks, *sets, F.count("*").alias("records"))
    duties = records.select(by, F.explode("obligations").alias("o"))
    if explicit is not None:
        said = explicit.select(by, *(F.col(use).alias(f"own_{use}") for use in USES))
        packs = packs.join(said, packs[by].eqNullSafe(said[by]), "left").drop(said[by])
        spoken = F.coalesce(*(F.col(f"own_{use}").cast("string") for use in USES)).isNotNull()
        packs = packs.withColumns({use: F.when(spoken, status_bits(F.col(f"own_{use}"))).otherwise(F.col(use)) for use in USES})
        duties = duties.unionByName(explicit.select(by, F.explode("obligations").alias("o")))
    listed = duties.select(by, text("o").alias("o")).groupBy(by).agg(F.array_sort(F.collect_set("o")).alias("obligations"))
    packs = packs.join(listed, packs[by].eqNullSafe(listed[by]), "left").drop(listed[by])
    uses = {use: status_of_bits(F.col(use)) for use in USES}
    packs = packs.withColumns(uses)
    permitted = F.array_contains(F.transform(F.array(*USES), lambda s: s.startswith("allowed")), True)
    return packs.select(
        by, "records", *USES, F.when(permitted, "permissioned").otherwise("unknown").alias("rights_status"),
        F.coalesce("obligations", F.array().cast("array<string>")).alias("obligations"), "source_domains", "license_hints",
        F.when(F.size("license_hints") == 1, F.col("license_hints")[0]).alias("detected_license"),
        F.when(F.col("pii"), "medium").otherwise("low").alias("pii_risk"), F.when(F.col("sensitive"), "medium").otherwise("low").alias("sensitive_data_risk"),
    )


def effective_rights(records: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """(key, the USES) of each record met with the rights of all that it is derived from, directly or not.

    ``derived`` are rows (child, parent); those of records that are not there pass nothing on.  A record of one parent
    jumps to it, then to where that jumps, and so on, gathering rights on the way, so a chain takes as many rounds as its
    length has binary digits.  Between records of several parents what is new goes on by rounds that look only at the
    children of those that the round before has changed.  Bits only grow, so rounds end, also where derivations
    go in a circle.  Repeated keys are one record.
    """
    bits = lambda rows, node: rows.groupBy(node).agg(*(F.bit_or(use).alias(use) for use in USES))
    own = records.select(F.col(key).alias("node"), *(status_bits(F.col(use)).alias(use) for use in USES))
    known = cut(bits(own, "node"))
    nodes = known.select("node")
    links = derived.where("child <> parent").select("child", "parent").distinct()
    links = cut(links.join(nodes.withColumnRenamed("node", "child"), "child", "left_semi").join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi"))
    single = links.groupBy("child").agg(F.min("parent").alias("parent"), F.count("*").alias("n")).where("n = 1").select(F.col("child").alias("node"), F.col("parent").alias("next"))
    moving = cut(known.join(single, "node"))
    steps, ended = moving.count().bit_length(), None  # after so many rounds only circles are left, gone round as a whole
    for _ in range(steps):
        ahead = moving.select(F.col("node").alias("next"), F.col("next").alias("after"), *(F.col(use).alias(f"more_{use}") for use in USES))
        more = {use: F.col(use).bitwiseOR(F.coalesce(F.col(f"more_{use}"), F.lit(0))) for use in USES}
        if ended is not None:  # who has come to the end of a chain is where others arrive
            ahead = ahead.unionByName(ended.select(F.col("node").alias("next"), F.col("next").alias("after"), *(F.col(use).alias(f"more_{use}") for use in USES)))
        jumped = cut(moving.join(ahead.hint("merge"), "next", "left").select("node", F.coalesce("after", "next").alias("next"), *(more[use].alias(use) for use in USES), F.col("after").isNull().alias("done")))
        over = jumped.where("done").drop("done")
        ended = over if ended is None else ended.unionByName(over)
        moving = jumped.where("not done").drop("done")
        if moving.isEmpty():
            break
    jumps = moving if ended is None else moving.unionByName(ended)
    return _spread(known, links, cut(jumps), key)


def _spread(known: DataFrame, links: DataFrame, jumps: DataFrame, key: str) -> DataFrame:
    """Rights of ``known`` (node, bits), of which ``jumps`` (node, next, bits) tell what is met on the way to ``next``."""
    more = {use: F.col(use).bitwiseOR(F.coalesce(F.col(f"more_{use}"), F.lit(0))) for use in USES}
    renamed = [F.col(use).alias(f"more_{use}") for use in USES]
    met_bits = lambda rows: rows.groupBy("node").agg(*(F.bit_or(f"more_{use}").alias(f"more_{use}") for use in USES))
    ends = known.join(jumps.select("node"), "node", "left_anti")
    # the links of records of several parents: what their parents meet comes at once, what ends of chains have comes by rounds
    several = links.join(ends.select(F.col("node").alias("child")), "child", "left_semi")
    arrived = several.join(jumps.select(F.col("node").alias("parent"), "next", *renamed), "parent", "left").select(F.col("child").alias("node"), F.coalesce("next", "parent").alias("from"), *(f"more_{use}" for use in USES))
    arrived = cut(arrived)
    first = cut(ends.join(met_bits(arrived), "node", "left").select("node", *(more[use].alias(use) for use in USES)))
    ways = cut(arrived.where("node <> from").select("node", "from").distinct())
    ends = fresh = first
    while not ways.isEmpty() and not fresh.isEmpty():
        come = met_bits(ways.join(fresh.select(F.col("node").alias("from"), *renamed), "from"))
        changed = F.array(*(more[use] for use in USES)) != F.array(*USES)
        joined = cut(ends.join(come, "node", "left").select("node", *(more[use].alias(use) for use in USES), changed.alias("changed")))
        ends, fresh = joined.drop("changed"), joined.where("changed").drop("changed")
    last = jumps.join(ends.select(F.col("node").alias("next"), *renamed), "next", "left").select("node", *(more[use].alias(use) for use in USES))
    return ends.unionByName(last).select(F.col("node").alias(key), *(status_of_bits(F.col(use)).alias(use) for use in USES))
