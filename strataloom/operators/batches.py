"""Greedy batches of ordered rows, and overlapping windows of a text's lines."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from strataloom.lineage import cut, slices
from strataloom.operators.ordered import running_sums

#: Rows of a group that one task goes through.
BLOCK = 1 << 16
CHUNK_TOKENS, OVERLAP_TOKENS = 1000, 200
BATCH_TOKENS, BATCH_ROWS = 7000, 100


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    units = F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.ceil(units / 4).cast("long")


def _next_starts(total: np.ndarray, tokens: np.ndarray, most_tokens: int, most_rows: int) -> np.ndarray:
    """For each row the place of the next batch's first row if a batch begins here; past the end if none follows.

    Running totals may fall where tokens are negative; within the rows of one batch the first one beyond the bound counts.
    """
    n = len(total)
    at = np.arange(n)
    limit = total - tokens + most_tokens
    if (tokens >= 0).all():
        beyond = np.maximum(np.searchsorted(total, limit, "right"), at + 1)
        return np.minimum(beyond, at + most_rows)
    out = at + most_rows
    for ahead in range(most_rows - 1, 0, -1):
        over = total[ahead:] > limit[: n - ahead]
        out[: n - ahead][over] = at[: n - ahead][over] + ahead
    return out


def _columns(rows: pa.Table, block: int) -> tuple[pa.Table, int, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in order with those of the next that a batch may reach: (rows, block's own, place, total, tokens)."""
    rows = rows.sort_by("_place")
    place, total, tokens = (rows.column(name).to_numpy() for name in ("_place", "_total", "_tokens"))
    own = int(np.searchsorted(place, (int(rows.column("_block")[0].as_py()) + 1) * block))
    return rows, own, place, total, tokens


def _exits(most_tokens: int, most_rows: int, block: int):
    """Where batches leave a block that enter it at each of its first rows; null if none does."""

    def run(rows: pa.Table) -> pa.Table:
        rows, own, place, total, tokens = _columns(rows, block)
        follow = _next_starts(total, tokens, most_tokens, most_rows).tolist()
        leave = list(range(len(place) + most_rows + 1))
        for i in range(own - 1, -1, -1):
            leave[i] = leave[follow[i]] if follow[i] < own else follow[i]
        entries = min(own, most_rows)
        ends = [int(place[0]) + x if x < len(place) else None for x in leave[:entries]]
        group = rows.column("_group").slice(0, 1).take(pa.array(np.zeros(entries, np.int64)))
        return pa.table([group, pa.array(place[:entries]), pa.array(ends, pa.int64())], ["_group", "entry", "exit"])

    return run


def _walk(most_tokens: int, most_rows: int, block: int, kept: list[str]):
    """The block's own rows with the number of batches begun in it so far, from its entry on."""

    def run(rows: pa.Table) -> pa.Table:
        rows, own, place, total, tokens = _columns(rows, block)
        follow = _next_starts(total, tokens, most_tokens, most_rows).tolist()
        begins = np.zeros(own, np.int64)
        entry = rows.column("_entry")[0].as_py()
        at = own if entry is None else entry - int(place[0])
        while at < own:
            begins[at] = 1
            at = follow[at]
        return rows.slice(0, own).select(kept).append_column("_begun", pa.array(np.cumsum(begins)))

    return run


def greedy_batches(rows: DataFrame, group: str, order: Sequence[str], tokens: Column, most_tokens: int = BATCH_TOKENS, most_rows: int = BATCH_ROWS, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``batch``, counted from 0 within their group.

    Rows are taken in order; one begins a new batch if the batch would have more than
    ``most_tokens`` with it, or has ``most_rows`` rows already.  A row that is too large is a batch
    of its own.  Where a batch ends depends on where it began, so blocks of a long group are
    gone through for every row at which a batch may enter them, at most ``most_rows``; doubling
    the steps from block to block finds the entries that occur, and blocks are numbered
    from these.  No task has more than a block of ``block`` rows, ``most_rows`` at least.  ``order`` has to tell the rows of a group apart.
    Null tokens count as 0; a null group is a group.
    """
    clash = {"_group", "_place", "_total", "_tokens", "_block", "_entry", "_begun"} & set(rows.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    sized = rows.withColumn("_tokens", F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))).withColumn("_group", F.struct(F.col(group).alias("of")))
    summed = running_sums(sized, ["_group"], order, {"_place": F.lit(1), "_total": F.col("_tokens")}).withColumn("_place", F.col("_place") - 1)
    placed = cut(summed.withColumn("_block", F.floor(F.col("_place") / block)))
    early = placed.where((F.col("_block") > 0) & (F.col("_place") % block < most_rows)).withColumn("_block", F.col("_block") - 1)
    blocks = placed.unionByName(early)
    kind = placed.schema["_group"].dataType
    shape = T.StructType([T.StructField("_group", kind), T.StructField("entry", T.LongType()), T.StructField("exit", T.LongType())])
    small = blocks.select("_group", "_block", "_place", "_total", "_tokens")
    steps = cut(small.groupBy("_group", "_block").applyInArrow(_exits(most_tokens, most_rows, block), shape).where("exit is not null"))
    entered = cut(placed.where("_place = 0").select("_group", F.col("_place").alias("entry")))
    longest = placed.agg(F.coalesce(F.max("_block"), F.lit(0))).first()[0]
    for _ in range(int(longest).bit_length()):
        on = [entered["_group"] == steps["_group"], entered["entry"] == steps["entry"]]
        entered = cut(entered.unionByName(entered.join(steps, on).select(entered["_group"], F.col("exit").alias("entry"))).distinct())
        again = steps.select(F.col("_group").alias("g"), F.col("entry").alias("e"), F.col("exit").alias("x"))
        steps = cut(steps.join(again, (F.col("_group") == F.col("g")) & (F.col("exit") == F.col("e"))).select("_group", "entry", F.col("x").alias("exit")))
    entries = entered.select("_group", F.floor(F.col("entry") / block).alias("_block"), F.col("entry").alias("_entry"))
    kept = [*rows.columns, "_group", "_block"]
    known = blocks.join(entries, ["_group", "_block"], "left")
    shape = T.StructType([*(known.schema[c] for c in kept), T.StructField("_begun", T.LongType())])
    walked = cut(known.select(*kept, "_place", "_total", "_tokens", "_entry").groupBy("_group", "_block").applyInArrow(_walk(most_tokens, most_rows, block, kept), shape))
    begun = walked.groupBy("_group", "_block").agg(F.max("_begun").alias("n"))
    earlier = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = begun.select("_group", "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return walked.join(before, ["_group", "_block"]).select(*rows.columns, (F.col("_before") + F.col("_begun") - 1).alias("batch"))


_HEADING = re.compile(r"^#+\s+(.+)$", re.M)
_WINDOWS = T.ArrayType(T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("content", T.StringType())]))


def _tokens_of(text: str) -> int:
    return -(-len(text.encode("utf-16-le", "surrogatepass")) // 8)


def line_windows(text: str, most: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, str | None, int, str]]:
    """(number, first heading, tokens, content) of windows of whole lines.

    A window ends before the line that would bring it over ``most`` tokens.  The next begins with
    as many of its last lines as have ``overlap`` tokens at most, and with that line.
    """
    lines = text.split("\n")
    sizes = [_tokens_of(line) for line in lines]
    bounds, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            bounds.append((start, i))
            start, held = i, 0
            while start > bounds[-1][0] and held + sizes[start - 1] <= overlap:
                start -= 1
                held += sizes[start]
        held += size
    bounds.append((start, len(lines)))
    out = []
    for number, (first, stop) in enumerate(bounds):
        content = "\n".join(lines[first:stop])
        heading = _HEADING.search(content)
        out.append((number, heading[1] if heading else None, _tokens_of(content), content))
    return out


def overlapping_windows(docs: DataFrame, keep: Sequence[str], text: str = "text", most: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """``keep`` columns with (chunk_index, heading, tokens, content) of each window of a text; a null text is empty and has one."""

    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, shape = ("chunk_index", "heading", "tokens", "content"), to_arrow_type(_WINDOWS)
        for batch in batches:
            yield pa.concat_arrays([pa.array([[dict(zip(names, w, strict=True)) for w in line_windows(t or "", most, overlap)] for t in part.to_pylist()], shape) for part in slices(batch)])

    windows = F.arrow_udf(split, _WINDOWS)
    return docs.select(*keep, F.explode(windows(F.col(text).cast("string"))).alias("w")).select(*keep, "w.*")
