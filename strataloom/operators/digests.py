"""Digests of sorted entries: a tree of blocks, and the digest of one canonical list."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.lineage import cut
from strataloom.operators.ordered import running_sums

#: Entries, or digests of blocks, that make a block.
BLOCK = 1024


def canonical_entry(**fields: Column) -> Column:
    """A JSON object with its names in order and no spaces."""
    return F.to_json(F.struct(*(fields[name].alias(name) for name in sorted(fields))), {"ignoreNullFields": "false"})


def tree_digests(entries: DataFrame, by: str, order: Sequence[str], value: str, block: int = BLOCK) -> DataFrame:
    """(by, entries, root): the digest of each group's values in order.

    Values are joined by line feeds, ``block`` at a time, and digested; so are the digests, until one is left.
    No task holds more than a block of a group.  ``order`` has to tell the entries of a group apart, or
    entries that it does not to be equal; a null value counts as empty and a null group is a group.
    """
    rows = entries.select(F.struct(F.col(by).alias("of")).alias("group"), *order, F.coalesce(F.col(value), F.lit("")).alias("_value"))
    level = running_sums(rows, ["group"], order, {"place": F.lit(1)}).select("group", (F.col("place") - 1).alias("place"), F.col("_value").alias("value"))
    sizes = roots = None
    while True:
        at = F.floor(F.col("place") / block).alias("place")
        blocks = level.groupBy("group", at).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "value"))).alias("held"))
        joined = F.array_join(F.transform("held", lambda e: e["value"]), "\n")
        level = cut(blocks.select("group", "place", "n", F.sha2(joined, 256).alias("value")))
        last = level.groupBy("group").agg(F.max("place").alias("last"), F.sum("n").alias("n"))
        sizes = last.select("group", F.col("n").alias("entries")) if sizes is None else sizes
        level = cut(level.join(last.drop("n"), "group"))
        found = level.where("last = 0").select("group", F.col("value").alias("root"))
        roots = found if roots is None else roots.unionByName(found)
        level = level.where("last > 0").select("group", "place", "value")
        if level.isEmpty():
            return sizes.join(roots, "group").select(F.col("group.of").alias(by), "entries", "root")


def _stream(names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest, n = None, None, 0
        out: list[tuple] = []
        for batch in batches:
            for group, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or group != of:
                    if digest is not None:
                        digest.update(b"]")
                        out.append((of, n, digest.hexdigest()))
                    of, digest, n = group, hashlib.sha256(b"["), 0
                digest.update((b"," if n else b"") + entry.encode())
                n += 1
        if digest is not None:
            digest.update(b"]")
            out.append((of, n, digest.hexdigest()))
        yield pa.record_batch([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], [names[0], "entries", names[1]])

    return run


def ascii_json(json: Column) -> Column:
    """JSON text with all characters beyond ASCII as escapes, in lower-case hexadecimal of UTF-16."""
    return F.arrow_udf(lambda texts: pa.array(["".join(c if c < "\x80" else "".join(f"\\u{u:04x}" for u in memoryview(c.encode("utf-16-le")).cast("H")) for c in t) for t in texts.to_pylist()]), "string")(json)


def list_digests(entries: DataFrame, by: str, order: str, entry: str) -> DataFrame:
    """(by, entries, root_hash): the digest of each group's entries, texts of JSON, as one JSON list in order.

    This digest is of one sequence, so a group's entries pass through one task, sorted before by Spark and
    one batch at a time; for groups of any size ``tree_digests`` is the one to use.
    """
    rows = entries.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias(by), F.col(entry).alias("entry"), F.col(order).alias("_order"))
    dealt = rows.repartition(by).sortWithinPartitions(by, "_order").select(by, "entry")
    return dealt.mapInArrow(_stream((by, "root_hash")), f"{by} string, entries long, root_hash string")
