"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lagoon.session import cut_lineage

#: Spark drops the shuffle files of a finished write where this is set; a stage that is read once needs them no more.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read back; the shuffle files of its making go at once."""
    with _setting(df.sparkSession, _CLEAN, "true"):
        return cut_lineage(df)


def bytes_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | dict]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that gives batches or dicts of columns."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in work(batch):
                yield out if isinstance(out, pa.RecordBatch) else as_batch(out, arrow)

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `most` bytes together, or one text if that is longer."""
    start = held = 0
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link: root is the least node of its connected component.

    edges: columns a, b; order, loops and repeats do not matter, rows with a null
    are left out. Alternating large and small stars: each round hangs every node
    on the least neighbour it knows, so rounds grow with the logarithm of the
    longest chain. A node's links are never gathered: least neighbours are sums
    by key, and the join that follows has one row per key on one side, so that
    adaptive execution can split a hot node. Each round is a table in the shared
    folder.
    """
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        seen = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stage(small.select("e.*").where("a <> b").distinct())


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def keep_rows(df: DataFrame, keep: Callable[[], Callable[[list[str]], list[bool]]], text_column: str = "text") -> DataFrame:
    """The rows whose text the predicate keeps, all columns as they are. keep() is called once in each task and gives the predicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = keep()
        for batch in batches:
            for part in slices(batch, text_column):
                yield part.filter(pa.array(good([t or "" for t in part.column(text_column).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
