"""Running numbers over sorted rows of any number of groups, none of which meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.lineage import cut


def running_sums(rows: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` with each value summed over the rows of its group up to and with its own.

    ``order`` has to tell the rows of a group apart.  A range sort deals rows to
    partitions in order, so that a group, however large, lies in several; within one the sums
    run over its own rows, and the totals of the group's earlier partitions, a row each,
    are added.  Null groups are groups.
    """
    own = {f"_sum_{name}": value for name, value in values.items()}
    sorted_rows = cut(rows.withColumns(own).orderBy(*group, *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(*group, "_part")
    totals = sorted_rows.groupBy(*group, "_part").agg(*(F.sum(c).alias(f"{c}_all") for c in own))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(totals.select(*(F.col(g).alias(f"_of_{g}") for g in group), F.col("_part").alias("_of_part"), *(F.coalesce(F.sum(f"{c}_all").over(earlier), F.lit(0)).alias(f"{c}_before") for c in own)))
    so_far = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = sorted_rows.withColumns({c: F.sum(c).over(so_far) for c in own})
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group] + [F.col("_part") == F.col("_of_part")]
    joined = within.join(before, same)
    return joined.select(*rows.columns, *((F.col(f"_sum_{name}") + F.col(f"_sum_{name}_before")).alias(name) for name in values))
