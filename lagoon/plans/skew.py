"""Ordered computations that never put one hot key into one task.

A plain window over a hot key sorts all of that key's rows in a single task, and
adaptive execution cannot split it. The helpers below cut every key into
*slices* that follow the order (a day, a block of sequence numbers), work inside
slices, and carry totals from slice to slice through a small aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ_SLICE = 1_000_000


def seq_slice(seq: str, size: int = SEQ_SLICE) -> Column:
    """Block of a unique integer sequence: at most `size` rows by construction."""
    return F.floor(F.col(seq) / F.lit(size)).cast("bigint")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key.

    Spark plans the rank filter as a group limit on the map side, so a hot key
    reaches the shuffle as one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def left_join_known(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left outer join where a null key, which matches nothing, never reaches the shuffle.

    Rows with a null in `on` would all meet in one task; they come back by union,
    with nulls for what right has. left is evaluated twice, so let it be a scan.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in on])
    added = [f for f in right.schema.fields if f.name not in on]
    some = left.filter(known).join(right, list(on), "left").select(*left.columns, *[f.name for f in added])
    rest = left.filter(~known).select(*left.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return some.unionByName(rest)


def _carried_to(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what their (key, slice) carries. Nulls are keys and slices like any other."""
    names = {k: f"_k{i}" for i, k in enumerate([*keys, "_slice"])}
    renamed = carried.withColumnsRenamed(names)
    same = reduce(and_, [rows[k].eqNullSafe(renamed[n]) for k, n in names.items()])
    return rows.join(renamed, same).drop(*names.values())


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column,
    sums: Mapping[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums per key, as new bigint columns.

    `slice_by` must follow the order: it never decreases along it (never
    increases when `descending`). The totals of earlier slices come from a
    partial aggregate, one row per (key, slice).
    """
    names = list(sums)
    sliced = df.withColumns({**{f"_v_{n}": c for n, c in sums.items()}, "_slice": slice_by})
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    along = Window.partitionBy(*keys).orderBy(F.desc("_slice") if descending else F.asc("_slice"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in names]
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = sliced.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_r_{n}") for n in names])
    return (
        _carried_to(inside, carried, keys)
        .select(*df.columns, *[(F.col(f"_c_{n}") + F.col(f"_r_{n}")).cast("bigint").alias(n) for n in names])
    )


def running_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_by: Column,
    descending: bool = False,
    name: str = "pos",
) -> DataFrame:
    """1-based position of each row within its key (see `running_sums`).

    The input is read twice, so keep it narrow: rank first, look attributes up
    afterwards.
    """
    return running_sums(df, keys, order, slice_by, {name: F.lit(1)}, descending)


def running_total(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, name: str, size: int = SEQ_SLICE
) -> DataFrame:
    """Inclusive running sum of `value` per key along a unique integer `seq`."""
    return running_sums(df, keys, [F.asc(seq)], seq_slice(seq, size), {name: F.col(value)})


def previous_value(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, name: str, size: int = SEQ_SLICE
) -> DataFrame:
    """Value of the preceding row of the same key along `seq` (null for the first)."""
    sliced = df.withColumn("_slice", seq_slice(seq, size))
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by(value, seq).alias("_last"))
    carried = last.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))
    ).drop("_last")
    within = Window.partitionBy(*keys, "_slice").orderBy(seq)
    inside = sliced.withColumn("_first", F.row_number().over(within) == 1).withColumn("_lag", F.lag(value).over(within))
    return (
        _carried_to(inside, carried, keys)
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_carry", "_lag", "_first", "_slice")
    )


def hash_page(key: Column, rows: Column, page_size: int) -> Column:
    """Spread an unordered set of `rows` members over pages of about `page_size`.

    Small sets get the single page 0; large ones are split by a stable hash, so
    no array grows with the data.
    """
    pages = F.greatest(F.lit(1), F.ceil(rows / F.lit(page_size))).cast("bigint")
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, pages)
