"""Per-viewer top-k over one shared ranking, without pairing viewers and users.

All viewers rank the same users by the same order and differ only in whom they
cannot see. So the users are ranked once, and a viewer's k-th place is a
position in that ranking that is not hidden from it. If the viewer's i-th hidden
place is h, there are h - i open ones before it; so the k-th open place is k plus
the number of hidden ones with h - i < k. Only how many there are for each h - i
below k matters, at most k numbers for a viewer who hides millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.plans.ranges import range_position

#: Places of the shared ranking that every task gets; places further down are joined.
BROADCAST_PLACES = 10_000


def visible_top(viewers: DataFrame, ranked_by: list[Column], users: DataFrame, hidden: DataFrame, k: int) -> DataFrame:
    """viewers(viewer_id), users(id, …), hidden(viewer_id, target_id) → (viewer_id, rank, id, …), ranks 1 to k.

    `ranked_by` should end with a unique column. Repeated pairs in hidden count
    once, targets that are no users not at all.
    """
    ranked = range_position(users, [], ranked_by, "_pos")
    places = ranked.select(F.col("id").alias("target_id"), "_pos")
    hits = hidden.select("viewer_id", "target_id").distinct().join(places, "target_id").select("viewer_id", "_pos")
    gaps = (
        range_position(hits, ["viewer_id"], [F.asc("_pos")], "_i")
        .select("viewer_id", (F.col("_pos") - F.col("_i")).alias("_open"))
        .filter(F.col("_open") < k)
        .groupBy("viewer_id", "_open")
        .agg(F.count("*").alias("_n"))
        .groupBy("viewer_id")
        .agg(F.collect_list(F.struct("_open", "_n")).alias("_gaps"), F.sum("_n").alias("_sum"))
    )
    ranks = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")
    some = F.filter("_gaps", lambda g: g["_open"] < F.col("rank"))
    hidden_before = F.coalesce(F.aggregate(some, F.lit(0).cast("bigint"), lambda n, g: n + g["_n"]), F.lit(0))
    place = (F.col("rank") + hidden_before).alias("_pos")
    rank = F.col("rank").cast("bigint").alias("rank")

    def open_places(who: DataFrame) -> DataFrame:
        return who.select("viewer_id", "_gaps", ranks).select("viewer_id", rank, place)

    shared = max(k, BROADCAST_PLACES)
    near = open_places(viewers.join(gaps, "viewer_id", "left")).filter(F.col("_pos") <= shared)
    far = open_places(viewers.join(gaps.filter(F.col("_sum") + k > shared), "viewer_id"))
    top = F.broadcast(ranked.filter(F.col("_pos") <= shared))
    below = ranked.filter(F.col("_pos") > shared)
    return near.join(top, "_pos").unionByName(far.join(below, "_pos")).drop("_pos")
