"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, name: str = "lagoon", **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing here sizes a cluster: executors, memory and shuffle parallelism stay
    with spark-submit. Adaptive execution coalesces small shuffles and splits
    skewed join partitions.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A machine-local folder is only ever chosen for a local master that names
    none; on a cluster a missing setting is an error, not a silent /tmp.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        base = named
    else:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="lagoon-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder; never reused between runs."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame as a table in the shared folder and read it back.

    A lost executor cannot lose it, and the reader starts from a plain scan: a
    round loop over such tables keeps plans of constant size, and their file
    sizes let the optimizer choose joins.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
