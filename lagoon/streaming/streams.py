"""Streaming twins: each equals its batch operator on the same input, in whatever order the rows arrive.

What a stream keeps is a fold table (see `folds`): each micro-batch is folded by
itself and written under its number, so a batch replayed after a failure replaces
itself. There is no state to restore and no watermark, so no row is too late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lagoon.operators import activity, limits, purchases
from lagoon.streaming.folds import Fold, FoldTable


# sources -----------------------------------------------------------------


def parquet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files: str | None = None, per_trigger: int | None = None
) -> DataFrame:
    """Parquet files as they arrive; `files` narrows a mixed folder by name."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def purchase_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Webhook bodies, one JSON document per line, parsed as in the batch reader."""
    return purchases.parse_purchase_events(spark.readStream.text(folder))


# sinks -------------------------------------------------------------------


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start the stream; without `every` it takes what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    query = writer.start()
    if not every:
        query.awaitTermination()
    return query


def keep(
    stream: DataFrame,
    part: Callable[[DataFrame, int], DataFrame],
    fold: Fold,
    folder: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Fold each micro-batch by `part` (rows, batch number) into the table at `folder`."""
    table = FoldTable(stream.sparkSession, folder, fold)
    return run_batches(stream, lambda df, n: table.write(part(df, n), n), checkpoint, every=every)


def read(spark: SparkSession, folder: str, fold: Fold) -> DataFrame:
    return FoldTable(spark, folder, fold).read()


# ledger and entitlements -------------------------------------------------

LEDGER = Fold(
    "transaction_id string, user_id string, product_id string, pearls int, created_at timestamp, seq bigint, batch bigint",
    lambda rows: rows.groupBy("transaction_id")
    .agg(F.min_by(F.struct("user_id", "product_id", "pearls", "created_at", "seq", "batch"), F.struct("batch", "seq")).alias("_v"))
    .select("transaction_id", "_v.*"),
)
PRO_STATE = Fold(
    "user_id string, pro_until timestamp, pro_lifetime boolean, seq bigint, batch bigint",
    lambda rows: rows.groupBy("user_id")
    .agg(F.max_by(F.struct("pro_until", "seq", "batch"), F.struct("batch", "seq")).alias("_v"), F.bool_or("pro_lifetime").alias("pro_lifetime"))
    .select("user_id", "_v.pro_until", "pro_lifetime", "_v.seq", "_v.batch"),
)


def _arrived(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("batch", F.lit(n).cast("bigint"))


def keep_ledger(effects: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Pay each transaction once, for ever: the first to arrive wins, by batch and then by seq.

    A batch does not look at the ledger: its first row for each transaction is
    written, and folding keeps the earliest. So a batch costs the same at any age of the
    ledger, and a replayed one meets nothing of its own.
    """
    return keep(effects, lambda df, n: _arrived(grants_of(df), n), LEDGER, folder, checkpoint, every)


def grants_of(effects: DataFrame) -> DataFrame:
    return effects.filter("kind = 'pearls' and user_id is not null").select(
        "transaction_id", "user_id", "product_id", "pearls", F.col("ts").alias("created_at"), "seq"
    )


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, LEDGER).drop("seq", "batch")


def keep_pro_state(effects: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The last expiry by arrival (batch, then seq) wins even when it is null; lifetime sticks."""
    return keep(effects, lambda df, n: _arrived(purchases.pro_state(df), n), PRO_STATE, folder, checkpoint, every)


def read_pro_state(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, PRO_STATE).drop("batch")


# sums, latest times, spells ----------------------------------------------


def _sums(ddl: str, keys: list[str], sums: list[str]) -> Fold:
    return Fold(ddl, lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]))


WEEKLY = _sums("user_id string, week_start date, week_mins bigint", ["user_id", "week_start"], ["week_mins"])
CALLS = _sums(
    "limit_key string, window_start timestamp, calls bigint, strict_calls bigint", ["limit_key", "window_start"], ["calls", "strict_calls"]
)
SEEN = Fold("user_id string, last_seen timestamp", lambda rows: rows.groupBy("user_id").agg(F.max("last_seen").alias("last_seen")))
PROGRESS = _sums(
    "room_id string, dives bigint, total_mins bigint, shared_depth bigint", ["room_id"], ["dives", "total_mins", "shared_depth"]
)
SPELLS = Fold("user_id string, started timestamp, ended timestamp, dives bigint", activity.merge_spells)
GATED = Fold("room_id string, user_id string, mins int, depth int, ts timestamp", lambda rows: rows)


def weekly_totals(dives: DataFrame) -> DataFrame:
    """Minutes per diver and Monday week of the given dives."""
    week = F.to_date(activity.monday_of(F.col("ts"))).alias("week_start")
    return dives.groupBy("user_id", week).agg(F.sum(F.col("mins").cast("bigint")).alias("week_mins"))


def call_counts(log: DataFrame, window: str = "15 minutes", strict=limits.STRICT, exempt=limits.EXEMPT) -> DataFrame:
    """Calls and strict calls per key and window, without exempt ones; whoever reads it compares with the budgets."""
    return (
        log.groupBy("limit_key", F.window("ts", window).alias("w"))
        .agg(*limits.budget_counts(strict, exempt))
        .select("limit_key", F.col("w.start").alias("window_start"), "calls", "strict_calls")
    )


def last_seen(dives: DataFrame) -> DataFrame:
    return dives.groupBy("user_id").agg(F.max("ts").alias("last_seen"))


def running_progress(dives: DataFrame) -> DataFrame:
    return dives.groupBy("room_id").agg(
        F.count("*").alias("dives"),
        F.sum(F.col("mins").cast("bigint")).alias("total_mins"),
        F.sum(F.col("depth").cast("bigint")).alias("shared_depth"),
    )


def gate_by_membership(dives: DataFrame, members: DataFrame) -> DataFrame:
    """Live dives of members only: a stream-static semi join."""
    return dives.join(members.select("room_id", "user_id"), ["room_id", "user_id"], "left_semi")
