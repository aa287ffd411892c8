"""Mixture-controlled packing by deficit round-robin, in closed form.

Every source is a queue: the token stream of its documents in id order, cut into
quanta. In round-robin by deficits a source earns credit in proportion to its
target share and sends its next quantum when it has earned half of it. So
quantum j of a source with weight w is due at time (2j + 1) / 2w, and the order
of all quanta by time, then source, is the order of the tokens: every window of
the output holds every source to within a quantum of its target, what one window
lacks is carried to the next, and so across partitions, because a quantum's
place is a formula of the sources' totals alone and not of what other tasks did.
A source that has run out earns no more; the others keep their proportions.

The QUEUES largest sources are scheduled by the formula, their totals held by the
driver. All others, however many, share one more queue that has their weights
together; its stream is their own quanta in the order of their own due times, by
running sums over ranges of that order, so each of them keeps its share, too. The
places of documents in their source's stream are sums over ranges of ids, so no
source is ever gathered in one task.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_map, slices, stage

WINDOW = 2048
QUANTUM = 128
END = 1
#: Sources that the driver schedules, by tokens; the rest are one queue that Spark schedules.
QUEUES = 255
#: Parts in a worker's cache.
CACHE = 600_000


#: A stop or comma that is a piece of its own: after a letter or digit, before white space.
_MARK = re.compile(r"(?<=[^\W_])([.,])(?= )")
#: A stop or comma before a blank that follows something else.
_RUN = re.compile(r"[.,](?<![^\W_][.,]) ")
_LOWER = {i: i + 32 for i in range(65, 91)}


def encoder(path: str):
    """A function from texts to token ids as bytes of unsigned 16-bit numbers; end token not included.

    The tokenizer lower-cases, drops white space and never merges across it, nor
    between a word and a mark, so the ids of a text are those of its parts; parts
    that occur again come from a cache of bounded size, which the worker process
    keeps from task to task. New words go to the tokenizer many at a time as one
    text: each ends with a token that only ends words, so the ids fall apart again.
    """
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("lagoon_llm_encoders", types.ModuleType("lagoon_llm_encoders")).__dict__
    if path not in kept:
        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        ends = np.zeros(1 << 16, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        kept[path] = (tokenizer, ends, {})
    tokenizer, ends, cache = kept[path]

    def alone(some: list[str]) -> None:
        for part, got in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            cache[part] = np.array(got.ids, np.uint16).tobytes()

    def together(some: list[str]) -> None:
        ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint16)
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(some):  # a letter that is two once lower-cased
            return alone(some)
        raw, begin = ids.tobytes(), 0
        for part, stop in zip(some, (2 * stops).tolist(), strict=True):
            cache[part] = raw[begin:stop]
            begin = stop

    def parts_of(text: str) -> list[str]:
        if "<|" in text:  # special tokens are told apart by case
            return text.split(" ")
        text = text.translate(_LOWER) if "\u03a3" in text or "\u0130" in text else text.lower()  # letters whose small form depends
        text = text.replace("\n", " ") + " "
        if _RUN.search(text):
            return _MARK.sub(r" \1", text).split(" ")
        return text.replace(". ", " . ").replace(", ", " , ").split(" ")

    def encode(texts: list[str]) -> list[bytes]:
        if len(cache) > CACHE:
            cache.clear()
        parts = [parts_of(t) for t in texts]
        missing = set().union(*parts).difference(cache)
        words = [w for w in missing if w.isalpha()]
        others = list(missing.difference(words))
        for i in range(0, len(words), 500):
            together(words[i : i + 500])
        for i in range(0, len(others), 500):
            alone(others[i : i + 500])
        return [b"".join(map(cache.__getitem__, p)) for p in parts]

    return encode


def tokenized(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """(rid, doc_id, source, n, ids): ids of every row's whole text and the end token, as little-endian 16-bit numbers."""
    ending = np.array([end], np.uint16).tobytes()

    def run(batches):
        encode = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                ids = [x + ending for x in encode([t or "" for t in part.column("t").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, source string, n long, ids binary").withColumn("rid", F.monotonically_increasing_id())


def placed(lengths: DataFrame) -> DataFrame:
    """lengths (rid, doc_id, queue, n) with at: tokens of the queue's earlier rows, in the order of doc_id, then rid.

    Rows are dealt to ranges of ids; each range sums its own, and the sums of the
    ranges before it, a small table, are added.
    """
    ranged = stage(lengths.repartitionByRange("doc_id", "rid").withColumn("slice", F.spark_partition_id()))
    before = ranged.groupBy("queue", "slice").agg(F.sum("n").alias("all"))
    earlier = F.sum("all").over(Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select("queue", "slice", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("queue", "slice").orderBy(F.asc_nulls_first("doc_id"), "rid"))
    return ranged.select("*", (inside - F.col("n")).alias("inside")).join(before, ["queue", "slice"]).select("rid", "queue", (F.col("inside") + F.col("before")).alias("at"))


class Schedule:
    """Places of tokens in the mixed stream, from the queues' totals and weights."""

    def __init__(self, totals: Mapping[int, int], weights: Mapping[int, int] | None = None, quantum: int = QUANTUM):
        self.quantum = quantum
        self.names = sorted(totals)
        self.row = {q: i for i, q in enumerate(self.names)}
        self.totals = [totals[q] for q in self.names]
        self.quanta = [-(-t // quantum) for t in self.totals]
        self.weights = [int(weights[q]) if weights else n for q, n in zip(self.names, self.quanta, strict=True)]
        self.all = sum(self.totals)

    def starts(self, queue: int, js: np.ndarray) -> np.ndarray:
        """Position of each of the queue's quanta js in the mixed stream: tokens of all quanta due before it."""
        s = self.row[queue]
        w = self.weights[s]
        exact = max(self.weights) * (2 * int(js.max(initial=0)) + 1) < 2**62
        due = (2 * js.astype(np.int64) + 1) if exact else np.array([2 * int(j) + 1 for j in js], object)
        out = np.zeros(len(js), np.int64)
        for r, (n, total, v) in enumerate(zip(self.quanta, self.totals, self.weights, strict=True)):
            if r == s:
                out += js * self.quantum
                continue
            # quanta i of r with (2i + 1) / v before due / w, or at the same time and r listed first
            top = due * v - w
            count = top // (2 * w) + 1 if r < s else -((-top) // (2 * w))
            count = np.clip(count, 0, n).astype(np.int64)
            out += np.minimum(count * self.quantum, total)
        return out

    def pieces(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start in document, length, position) of the parts into which quanta cut n tokens at `at` of a queue's stream."""
        q = self.quantum
        first, last = at // q, (at + n - 1) // q
        many = last - first + 1
        row = np.repeat(np.arange(len(n)), many)
        js = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
        low, high = np.maximum(js * q, at[row]), np.minimum((js + 1) * q, (at + n)[row])
        position = low - js * q
        for x in np.unique(queue):
            own = queue[row] == x
            position[own] += self.starts(int(x), js[own])
        start, length = low - at[row], high - low
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (position[1:] != position[:-1] + length[:-1])
        first = np.flatnonzero(fresh)
        return row[first], start[first], np.add.reduceat(length, first), position[first]

    def sequences(self, position: int, window: int) -> tuple[int, int, int]:
        """(sequence, offset, room) of a position. The last window is dealt to sequences of powers of two: nothing is padded."""
        full = self.all // window
        k, offset = divmod(position, window)
        if k < full:
            return k, offset, window - offset
        rest, sequence = self.all % window, full
        for bit in range(rest.bit_length() - 1, -1, -1):
            size = rest & (1 << bit)
            if size:
                if offset < size:
                    return sequence, offset, size - offset
                offset -= size
                sequence += 1
        raise ValueError("position beyond the stream")


def _key(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def shared_queue(lengths: DataFrame, weights: DataFrame | None, quantum: int = QUANTUM) -> DataFrame:
    """lengths (rid, doc_id, queue, n), queue the `_key` of a source → (rid, cuts): where the quanta of each row's source lie in the shared stream.

    cuts: start in the document, length, at. weights: queue, w; without them a
    source weighs what it has, and without one a source weighs 1.
    """
    at = stage(placed(lengths).join(lengths.select("rid", "n"), "rid"))
    totals = lengths.groupBy("queue").agg(F.sum("n").alias("all")).withColumn("many", F.ceil(F.col("all") / quantum))
    if weights is None:
        weighed = totals.withColumn("w", F.col("many").cast("double"))
    else:
        weighed = totals.join(weights, F.col("queue") == F.col("q"), "left").select("queue", "all", "many", F.coalesce("w", F.lit(1.0)).alias("w"))
    quanta = weighed.select("queue", "all", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("j"))
    quanta = quanta.select("queue", "j", F.least(F.lit(quantum).cast("long"), F.col("all") - F.col("j") * quantum).alias("size"), ((2 * F.col("j") + 1) / (2 * F.col("w"))).alias("due"))
    order = [F.asc("due"), F.asc("queue"), F.asc("j")]
    ranged = stage(quanta.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    sums = ranged.groupBy("slice").agg(F.sum("size").alias("sum"))  # a row for each partition
    before = sums.select("slice", F.coalesce(F.sum("sum").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("slice").orderBy(*order)) - F.col("size")
    spots = ranged.withColumn("inside", inside).join(before, "slice").select(F.col("queue").alias("q"), "j", (F.col("inside") + F.col("before")).alias("spot"))
    pieces = at.select("rid", "queue", "at", "n", F.explode(F.sequence(F.floor(F.col("at") / quantum), F.floor((F.col("at") + F.col("n") - 1) / quantum))).alias("p"))
    pieces = pieces.join(spots, (F.col("queue") == F.col("q")) & (F.col("p") == F.col("j")))
    low, high = F.greatest(F.col("p") * quantum, "at"), F.least((F.col("p") + 1) * quantum, F.col("at") + F.col("n"))
    cut = F.struct((low - F.col("at")).alias("start"), (high - low).alias("length"), (F.col("spot") + low - F.col("p") * quantum).alias("at"))
    return pieces.groupBy("rid").agg(F.sort_array(F.collect_list(cut)).alias("cuts"))  # a row's tokens by the quantum at most


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    weights: Mapping[str, int] | None = None,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    end: int = END,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    docs: doc_id, source, text. weights: target share of each source, by default
    its share of the tokens, so that all sources end together; sources without a
    weight get 1. Null text counts as empty (the end token alone), a null source
    is a source, repeated rows and null ids are packed like any other. Full
    windows hold `window` tokens; the rest is dealt to sequences whose lengths
    are different powers of two, which need no padding.
    """
    tokens = stage(tokenized(docs, tokenizer_path, end))
    sums = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    top = [(r["source"], r["n"]) for r in sums.orderBy(F.desc("n"), "source").limit(QUEUES).collect()]
    queues = {source: i for i, (source, _) in enumerate(sorted(top, key=lambda x: (x[0] is not None, x[0])))}
    totals = {queues[s]: n for s, n in top}
    rest = (sums.agg(F.sum("n")).first()[0] or 0) - sum(totals.values())
    named = {queues[s]: (weights.get(s, 1) if weights else 1) for s in queues}
    given = None
    if rest:
        totals[QUEUES] = rest
        if weights:
            spark = docs.sparkSession
            given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "q string, w double").select(_key(F.col("q")).alias("q"), "w")
            small = sums.join(spark.createDataFrame([(s,) for s in queues], "s string"), F.col("source").eqNullSafe(F.col("s")), "left_anti")
            many = small.count()
            listed = small.join(given, _key(F.col("source")) == F.col("q")).agg(F.sum("w"), F.count("*")).first()
            named[QUEUES] = (listed[0] or 0) + many - listed[1]
    if weights:  # whole numbers, as weights may be fractions
        scale = 1 if all(float(w).is_integer() for w in named.values()) else 1_000_000
        named = {q: max(1, round(w * scale)) for q, w in named.items()}
    schedule = Schedule(totals, named if weights else None, quantum)
    queue = F.lit(QUEUES)
    for s, i in queues.items():
        queue = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(i)).otherwise(queue)
    lengths = tokens.select("rid", "doc_id", queue.alias("queue"), "source", "n")
    own = placed(lengths.where(F.col("queue") < QUEUES).drop("source")) if rest else placed(lengths.drop("source"))
    rows = tokens.select("rid", "doc_id", "n", "ids").join(own, "rid").withColumn("cuts", F.lit(None).cast("array<struct<start:long,length:long,at:long>>"))
    if rest:
        shared = shared_queue(lengths.where(F.col("queue") == QUEUES).select("rid", "doc_id", _key(F.col("source")).alias("queue"), "n"), given, quantum)
        others = tokens.select("rid", "doc_id", "n", "ids").join(shared, "rid").select("rid", "doc_id", "n", "ids", F.lit(QUEUES).alias("queue"), F.lit(0).cast("long").alias("at"), "cuts")
        rows = rows.unionByName(others)

    def work(batch):
        for part in slices(batch, "ids"):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            doc, n, ids = (part.column(c).to_pylist() for c in ("doc_id", "n", "ids"))
            wide = [np.frombuffer(x, "<u2").astype("<u4") for x in ids]
            queue, at, size = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "at", "n"))
            row, skipped = np.arange(len(size)), np.zeros(len(size), np.int64)
            if part.column("cuts").null_count < len(size):  # rows of the shared queue, cut by the quanta of their sources
                cuts = [c or [{"start": 0, "length": m, "at": a}] for c, m, a in zip(part.column("cuts").to_pylist(), size.tolist(), at.tolist(), strict=True)]
                row = np.repeat(row, [len(c) for c in cuts])
                skipped, size, at = (np.array([c[k] for x in cuts for c in x], np.int64) for k in ("start", "length", "at"))
                queue = queue[row]
            cut = schedule.pieces(queue, at, size)
            for k, start, length, position in zip(*(x.tolist() for x in cut), strict=True):
                start, k = start + int(skipped[k]), int(row[k])
                while length:
                    sequence, offset, room = schedule.sequences(position, window)
                    take = min(room, length)
                    for c, v in zip(out, (doc[k], start, take, zlib.crc32(wide[k][start : start + take].tobytes()), n[k], sequence, offset), strict=True):
                        out[c].append(v)
                    start, length, position = start + take, length - take, position + take
            yield out

    return arrow_map(rows, work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
