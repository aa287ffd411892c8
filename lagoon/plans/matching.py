"""First come, first served on two unique keys at once.

A claim is granted when neither of its keys was granted to an earlier claim. A
claim that comes first for both its keys is granted whatever happens to the
others, so each round grants all of these and drops every claim on a granted
key. Rounds follow the longest chain of claims displacing one another, which
has nothing to do with how many claims share a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.session import cut_lineage


def grant_in_order(claims: DataFrame, seq: str, a: str, b: str) -> DataFrame:
    """`seq` of the granted claims(seq, a, b); a null key is never contested."""
    claims = cut_lineage(claims.select(seq, a, b))
    granted = None
    while True:
        # What is still open follows from the grants so far; only grants are kept per round.
        open_claims = claims
        if granted is not None:
            for key in (seq, a, b):
                taken = granted.select(key).filter(F.col(key).isNotNull())
                open_claims = open_claims.join(taken, key, "left_anti")
        won = cut_lineage(_first_on_both(open_claims, seq, a, b))
        if won.isEmpty():
            return claims.limit(0).select(seq) if granted is None else granted.select(seq)
        granted = won if granted is None else granted.unionByName(won)


def _first_on_both(claims: DataFrame, seq: str, a: str, b: str) -> DataFrame:
    first = [
        claims.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias(seq)).select(seq) for key in (a, b)
    ]
    wins = first[0].unionByName(first[1]).groupBy(seq).agg(F.count("*").alias("_w"))
    needed = F.col(a).isNotNull().cast("int") + F.col(b).isNotNull().cast("int")
    return claims.join(wins, seq, "left").filter(F.coalesce("_w", F.lit(0)) == needed).drop("_w")


def assign_preferences(wishes: DataFrame, seq: str, names: str, keys: str) -> DataFrame:
    """wishes(seq, names, keys): the best name of each request that no earlier request holds.

    `names` is a request's short ordered list and `keys` what must be unique.
    Earlier requests have priority everywhere, so letting each request hold its
    best open wish, and moving on whoever is beaten by an earlier one, ends in
    exactly the serial result. A request moves at most as often as it has
    wishes. Every step is materialised, because the next one reads it twice.
    """
    state = cut_lineage(wishes.select(seq, names, keys, F.lit(0).alias("_at"), F.lit(False).alias("_moved")))
    while True:
        state = cut_lineage(_move_on(state, seq, names, keys))
        if state.filter("_moved").isEmpty():
            return state.filter(F.col("_at") < F.size(names)).select(seq, F.get(names, F.col("_at")).alias("name"))


def _move_on(state: DataFrame, seq: str, names: str, keys: str) -> DataFrame:
    """One step: per key the earliest holder stays, everybody else takes the next wish."""
    holding = state.filter(F.col("_at") < F.size(keys)).select(seq, F.get(keys, F.col("_at")).alias("_key"))
    keepers = holding.groupBy("_key").agg(F.min(seq).alias(seq)).select(seq, F.lit(True).alias("_keeps"))
    beaten = (F.col("_at") < F.size(keys)) & F.col("_keeps").isNull()
    return state.join(keepers, seq, "left").select(
        seq, names, keys, (F.col("_at") + beaten.cast("int")).alias("_at"), beaten.alias("_moved")
    )
