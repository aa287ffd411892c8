"""Renames as if one after another: who holds a name from which request to which.

A request is granted if nobody else holds the name just then, and it frees the
name its holder had before. Whether a name is held follows from earlier requests
alone, so there is one assignment of verdicts that agrees with itself, and it is
the serial one. Each pass takes the last one's verdicts for what frees names, and
plays all names side by side, each along its own timeline. A pass that changes
nothing ends it; passes follow the longest chain of names freed for one another,
not how many requests want one name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.plans.skew import previous_value
from lagoon.session import cut_lineage

HELD, WANTED, FREED = range(3)


def grant_in_turn(requests: DataFrame, holders: DataFrame) -> DataFrame:
    """requests(seq, user_id, key), holders(user_id, key) → seq of the granted requests.

    seq is unique, a user holds one key at a time. Asking for the key one holds is granted.
    """
    requests = cut_lineage(requests.select("seq", "user_id", "key"))
    wanted = requests.select("key").distinct()
    held = cut_lineage(holders.select("user_id", "key").join(wanted, "key", "left_semi"))
    first = holders.select("user_id", F.col("key").alias("_first")).join(requests.select("user_id").distinct(), "user_id", "left_semi")
    first = cut_lineage(first)
    verdicts = cut_lineage(requests.withColumns({"ok": F.lit(True), "changed": F.lit(True)}))
    while not verdicts.filter("changed").isEmpty():
        verdicts = cut_lineage(_pass(verdicts, held, first))
    return verdicts.filter("ok").select("seq")


def _pass(verdicts: DataFrame, held: DataFrame, first: DataFrame) -> DataFrame:
    granted = verdicts.filter("ok").select("seq", "user_id", "key")
    left = previous_value(granted, ["user_id"], "seq", "key", "_before").join(first, "user_id", "left")
    left = left.withColumn("_left", F.coalesce("_before", "_first")).filter("_left <> key")
    start = F.lit(None).cast("bigint")
    lines = (
        held.select("key", start.alias("seq"), F.lit(HELD).alias("kind"), "user_id")
        .unionByName(verdicts.select("key", "seq", F.lit(WANTED).alias("kind"), "user_id"))
        .unionByName(left.select(F.col("_left").alias("key"), "seq", F.lit(FREED).alias("kind"), "user_id"))
    )
    lines = lines.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("seq"), "kind")
    now = lines.select("key", "seq", "kind", "user_id").mapInArrow(_timelines, "seq bigint, _now boolean")
    return verdicts.join(now, "seq").select(
        "seq", "user_id", "key", F.col("_now").alias("ok"), (F.col("_now") != F.col("ok")).alias("changed")
    )


def _timelines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of keys → whether each request finds its key free or its own. Besides a key's holders nothing is held."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    seqs: list[int] = []
    oks: list[bool] = []

    def ready() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(oks, pa.bool_())], ["seq", "_now"])
        seqs.clear()
        oks.clear()
        return out

    for _, line in groupby(rows(), key=lambda r: r[0]):
        holders: set[str] = set()
        for _, seq, kind, user in line:
            if kind == HELD:
                holders.add(user)
            elif kind == FREED:
                holders.discard(user)
            else:
                ok = not holders - {user}
                if ok:
                    holders.add(user)
                seqs.append(seq)
                oks.append(ok)
                if len(seqs) >= 10_000:
                    yield ready()
    if seqs:
        yield ready()
