"""Joins of rows of which many share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.lineage import cut

#: Rows of one key from which on the key is hot.
HOT_ROWS = 1 << 14
#: Largest side, in estimated bytes, that is sent to every executor.
BROADCAST_BYTES = 16 << 20


def join_split(rows: DataFrame, side: DataFrame, key: str, row_bytes: int = 256) -> DataFrame:
    """Left join of ``rows`` with ``side`` on ``key``, whose hot keys stay where they are.

    Keys are counted first, combined before the shuffle.  The side's rows of hot keys are counted
    too and broadcast where ``row_bytes`` each stay under a bound; the rows of all other keys
    are shuffled.  Null keys find nothing.
    """
    hot = cut(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= HOT_ROWS).select(key))
    n = hot.count()
    if not n or n * row_bytes > BROADCAST_BYTES:
        return rows.join(side, key, "left")
    hot = F.broadcast(hot)
    own = cut(side.join(hot, key, "left_semi"))
    if own.count() * row_bytes > BROADCAST_BYTES:
        return rows.join(side, key, "left")
    cold = rows.join(hot, key, "left_anti").join(side, key, "left")
    return rows.join(hot, key, "left_semi").join(F.broadcast(own), key, "left").unionByName(cold)
