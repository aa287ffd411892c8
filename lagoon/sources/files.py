"""Files in and out, schema evolution, and idempotent appends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon import schemas
from lagoon.plans.skew import first_per_key


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One domain table from parquet, brought to the current schema."""
    return conform(
        spark.read.parquet(f"{folder.rstrip('/')}/{name}"), schemas.TABLES[name], schemas.DEFAULTS.get(name, {})
    )


def write_table(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{folder.rstrip('/')}/{name}")


def read_table_jdbc(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """The same table from a database. Pass `partitionColumn`, `lowerBound`,
    `upperBound` and `numPartitions` to read it in parallel."""
    df = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()
    return conform(df, schemas.TABLES[name], schemas.DEFAULTS.get(name, {}))


def read_json_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with missing fields tolerated; bad lines land in `_corrupt_record`."""
    wide = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)


def write_json_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Add missing columns (with their default), cast and order the rest; what does not cast is null."""
    defaults = defaults or {}
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def append_new(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Incoming rows whose key is new, the earliest per key: insert-or-ignore.

    The caller appends the result. Known keys are dropped before duplicates are
    ranked, so a hot known key costs no ranking.
    """
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti")
    return first_per_key(fresh, keys, order)
