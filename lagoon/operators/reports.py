"""Reports about other divers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions.scalars import cap_text, minted_id
from lagoon.functions.text import trim_all


def ingest_reports(raw: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """raw(seq, reporter_id, target_id, reason): rows to append.

    The target must exist; repeats and self-reports are kept on purpose.
    """
    asked = raw.withColumn("target_id", trim_all(F.coalesce("target_id", F.lit(""))))
    known = users.select(F.col("id").alias("target_id"))
    return asked.join(known, "target_id", "left_semi").select(
        minted_id("rp", F.col("reporter_id"), F.col("seq")).alias("id"),
        "reporter_id",
        "target_id",
        cap_text(F.col("reason"), 500).alias("reason"),
        as_of.alias("created_at"),
    )
