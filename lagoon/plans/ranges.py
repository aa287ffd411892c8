"""Positions along an order by range partitioning: no key, and no instant, is ever one task.

Rows are range-partitioned by (keys, order), so a key with a third of all rows,
or a million rows of one instant, is cut where the order's next column differs.
The sorted rows are written once with their place; a count per (key, partition)
then tells how many rows of a key lie in the partitions before. Only these
counts meet in a window: one row for each partition a key reaches into.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.session import cut_lineage

#: monotonically_increasing_id() has the partition above these bits.
_ROW_BITS = 33


def range_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos", total: str | None = None
) -> DataFrame:
    """df with each row's 1-based position within its key along `order`; with `total`, also the key's number of rows.

    Without keys the position is over all rows. A null key is a key like any
    other. `order` should end with a unique column: rows that tie in all of it
    are numbered as they come, and stay in one partition. The input is evaluated
    twice (bounds are sampled first) and its sorted rows become a table in the
    shared folder, so keep it narrow: rank first, look attributes up afterwards.
    """
    along = [*(F.asc_nulls_first(k) for k in keys), *order]
    placed = df.repartitionByRange(*along).sortWithinPartitions(*along)
    placed = cut_lineage(placed.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    counts = placed.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    # without keys there is one row per partition and nothing to partition the window by
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"),
        (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(of_key).alias("_total"),
    )
    same = reduce(and_, [placed[k].eqNullSafe(carried[f"_k{i}"]) for i, k in enumerate(keys)], part == carried["_p"])
    totals = [F.col("_total").alias(total)] if total else []
    return placed.join(carried, same).select(
        *df.columns, (F.col("_place") + F.col("_shift")).cast("bigint").alias(name), *totals
    )
