"""Mixing sources to target weights by fitting subset sums of exact document lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.llm.common import BROADCAST_BYTES, cut

WORD = r"[^\x20\x09-\x0D]+"
#: Budget that dynamic programming closes exactly; what lies above goes by whole lengths.
TABLE_BUDGET = 1 << 14
#: Bits of all states of the table for a source whose lengths leave a gap otherwise.
TABLE_BITS = 1 << 29
#: Rows, about, among which places are ranked in one group.
RANKED_ROWS = 512


def source_targets(sources: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Sources in code point order, null last, take the ``weights`` in turn.  All share the
    total by weight; a target stops at ``max_repeats`` times its source's size, and what
    is above is shared again.  That is a water level: in order of size by weight, a
    source is full while its share of what the fuller ones left is too much for it.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn)).withColumn("most", F.col("source_size") * max_repeats)
    level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    filled = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - past("most")).alias("left"),
        (F.sum("weight").over(everything) - past("weight")).alias("sharers"),
    )
    filled = filled.withColumn("full", F.col("most") * F.col("sharers") <= F.col("weight") * F.col("left"))
    rest = lambda c: F.sum(F.when(~F.col("full"), F.col(c))).over(everything)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0))
    share = F.col("weight") * (F.sum("source_size").over(everything) - taken) / rest("weight")
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _closest_subset(sizes: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each size sum closest to ``budget``: bounded knapsack over a bit set.

    Bit s of a state is set when some choice sums to s.  Counts are split into powers of
    two; states stop growing once the budget itself is reached.
    """
    room = (1 << (2 * budget + 1)) - 1
    states, items = [1], []
    for size, count in zip(sizes, counts, strict=True):
        step, count = 1, min(count, 2 * budget // size)
        while count > 0 and not states[-1] >> budget & 1 and size <= 2 * budget:
            n = min(step, count)
            new = (states[-1] | states[-1] << (n * size)) & room
            if new != states[-1]:
                states.append(new)
                items.append((size, n))
            count -= n
            step *= 2
    reached = states[-1]
    below = (reached & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reached >> budget
    over = budget + (above & -above).bit_length() - 1 if above else 2 * budget + 1
    total = over if over - budget < budget - below else below
    chosen: dict[int, int] = {}
    for (size, n), before in zip(items[::-1], states[-2::-1], strict=True):
        if not before >> total & 1:
            chosen[size] = chosen.get(size, 0) + n
            total -= n * size
    return chosen


def fit_lengths(sizes: np.ndarray, counts: np.ndarray, target: float, max_repeats: int) -> tuple[int, np.ndarray]:
    """Rounds of the whole source, and for each size how many documents give one time more.

    Each length first gives its share of the remaining budget, rounded down; longer
    documents then fill what is left down to ``TABLE_BUDGET``, and dynamic programming
    over the lengths that still have documents closes the rest.  If none of them fits
    into what is left, the shortest is taken where going over is closer.  Where a gap
    stays, the whole remaining budget is fitted again without shares, if that table has
    at most ``TABLE_BITS``, and the closer choice counts.
    """
    whole_size = sum(s * c for s, c in zip(sizes.tolist(), counts.tolist(), strict=True))
    if whole_size == 0:
        return 0, np.zeros(len(sizes), np.int64)
    budget = round(target)
    rounds = min(max_repeats, budget // whole_size)
    budget -= rounds * whole_size
    if rounds == max_repeats:
        return rounds, np.zeros(len(sizes), np.int64)
    extra = [c * budget // whole_size if s else 0 for s, c in zip(sizes.tolist(), counts.tolist(), strict=True)]
    left = budget - sum(k * s for k, s in zip(extra, sizes.tolist(), strict=True))
    order = np.argsort(-sizes, kind="stable").tolist()
    for i in order:
        size = int(sizes[i])
        if size and left > TABLE_BUDGET:
            n = min(int(counts[i]) - extra[i], (left - TABLE_BUDGET + size - 1) // size, left // size)
            extra[i] += n
            left -= n * size
    free = [i for i in order if sizes[i] and counts[i] > extra[i]]
    if left > TABLE_BUDGET:  # every free length is longer than what is left
        if free and int(sizes[free[-1]]) - left < left:
            extra[free[-1]] += 1
            left -= int(sizes[free[-1]])
    elif left:
        chosen = _closest_subset([int(sizes[i]) for i in free], [int(counts[i]) - extra[i] for i in free], left)
        for i in free:
            extra[i] += chosen.get(int(sizes[i]), 0)
            left -= chosen.get(int(sizes[i]), 0) * int(sizes[i])
    items = sum(int(c).bit_length() for s, c in zip(sizes, counts, strict=True) if s)
    if left and items * (2 * budget + 1) <= TABLE_BITS:
        chosen = _closest_subset([int(sizes[i]) for i in order if sizes[i]], [int(counts[i]) for i in order if sizes[i]], budget)
        if abs(budget - sum(s * n for s, n in chosen.items())) < abs(left):
            extra = [chosen.get(int(s), 0) for s in sizes]
    return rounds, np.array(extra, np.int64)


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 0,
    draw_by: str | None = None,
) -> DataFrame:
    """(key, source, size, source_size, target, repeats, taken) for every document.

    A size is a text's number of words, 0 for null.  ``taken`` is size times repeats and
    a source's taken words sum to its target as nearly as its lengths allow.  Which
    documents of a length are taken once more is drawn by ``seed`` from ``draw_by``, the
    key unless given; ties follow a hash of the text, so that runs agree however the rows are
    dealt.  A null source is a source; an empty table gives an empty result, repeated rows
    are documents of their own, and other columns play no part, whatever their names.
    """
    by = F.col(draw_by or key).alias("by")
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    sized = cut(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), words.alias("size"), by, F.xxhash64(text).alias("row")))
    lengths = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = cut(source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeats))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rounds, extra = fit_lengths(rows["size"].to_numpy(), rows["n"].to_numpy(), float(rows["target"].iloc[0]), max_repeats)
        return rows.assign(rounds=rounds, extra=extra)

    # a source's group has one row per length, however many documents it has
    known = lengths.join(targets, same(lengths, targets, ["source"])).select(lengths["source"], "size", "n", "source_size", "target")
    kind = sized.schema["source"].dataType.simpleString()
    plan = cut(known.groupBy("source").applyInPandas(fit, f"source {kind}, size long, n long, source_size long, target double, rounds long, extra long"))

    # a row per source and length; where they are few, a frequent length needs no shuffle
    side = F.broadcast(plan) if plan.count() * 96 <= BROADCAST_BYTES else plan
    planned = sized.join(side, same(sized, plan, ["source", "size"])).select(sized["id"], sized["row"], sized["source"], sized["size"], "by", "n", "source_size", "target", "rounds", "extra")
    draw = F.xxhash64(F.lit(seed), "by")
    part = F.when((F.col("extra") > 0) & (F.col("extra") < F.col("n")), F.pmod(draw, F.floor(F.col("n") / RANKED_ROWS) + 1))
    planned = cut(planned.withColumn("draw", draw).withColumn("part", part))
    some = planned.where("part is not null")
    parts = some.groupBy("source", "size", "part").agg(F.count("*").alias("here"))
    running = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("here").over(running), F.lit(0)))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "row")))
    ranked = ranked.join(parts, same(ranked, parts, ["source", "size", "part"])).select(ranked["id"], ranked["source"], ranked["size"], "source_size", "target", "rounds", (F.col("before") + F.col("rank") <= F.col("extra")).alias("once_more"))
    rest = planned.where("part is null").select("id", "source", "size", "source_size", "target", "rounds", (F.col("extra") > 0).alias("once_more"))
    repeats = (F.col("rounds") + F.col("once_more").cast("long")).alias("repeats")
    out = rest.unionByName(ranked).select(F.col("id").alias(key), "source", "size", "source_size", "target", repeats)
    return out.withColumn("taken", F.col("size") * F.col("repeats"))
