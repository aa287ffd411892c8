"""Ranked lexical search with upper bounds from hashed max-sketches.

A term's impact on a document is its weight times its saturated frequency there.
A document's sketch has COORDINATES cells; each impact is folded into the cell
that its term is hashed to, by maximum. The sum of an item's cells is then an
upper bound of its score, since no cell is below any impact it holds. The bounds
of a batch of documents for all items of a block are looked up together;
documents are rescored exactly in descending order of their bounds until the
bound falls below the score that is needed to be among the best.

Items are taken in blocks of bounded text, all documents against each block.
Only terms of the block weigh there, so that sketches hold little else; the
documents' statistics are counted over the whole corpus.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.common import bytes_of, slices, stage

BEST = 10
COORDINATES = 1024
#: Text of a block of items.
BLOCK_BYTES = 4 << 20
#: Cells that a lookup of bounds may take at once.
CELLS = 1 << 21
#: Parts in which the best of an item are chosen first.
PARTS = 64
#: Letters and digits of ASCII, A-Z as a-z, and all bytes of other characters stay; the rest parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weight(n: int, df: int) -> int:
    """Of a term that df of n documents have."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_norm(terms: int | np.ndarray, documents: int, total: int) -> int | np.ndarray:
    """m of a document with so many terms, of so many documents with `total` terms together."""
    return 10 + (90 * terms * documents) // total


def saturated(tf: int | np.ndarray, m: int | np.ndarray) -> int | np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Items:
    """A block of items: names by number, and the numbers of each one's terms in the block's vocabulary."""

    names: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        """rows: (name, text); items without terms are left out, nothing ranks for them."""
        vocabulary: dict[bytes, int] = {}
        names, terms = [], []
        for name, text in rows:
            own = sorted(set(terms_of(text.encode())))
            if own:
                names.append(name)
                terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in own], np.int64))
        return cls(names, vocabulary, terms)


@dataclass
class Statistics:
    documents: int
    total: int
    df: np.ndarray


def count(docs: DataFrame, items: Items, text_column: str = "text") -> Statistics:
    """Documents with a term, all their terms, and how many documents have each of the items' terms."""
    vocabulary = items.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                for text in bytes_of(part.column("t")):
                    found = terms_of(text)
                    documents += bool(found)
                    total += len(found)
                    df[[vocabulary[t] for t in vocabulary.keys() & set(found)]] += 1
        some = np.flatnonzero(df)
        term = np.concatenate([[-2, -1], some]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.concatenate([[documents, total], df[some]]).astype(np.int64))], ["term", "n"])

    sums = docs.select(F.col(text_column).cast("string").alias("t")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}  # a row for each term of the block at most
    return Statistics(found.get(-2, 0), found.get(-1, 0), np.array([found.get(k, 0) for k in range(len(vocabulary))], np.int64))


class Sketches:
    """Bounds and exact scores of documents for the items of a block."""

    def __init__(self, items: Items, stats: Statistics, coordinates: int = COORDINATES):
        self.items, self.stats, self.coordinates = items, stats, coordinates
        self.weights = np.array([weight(stats.documents, int(df)) for df in stats.df], np.int64)
        self.cell = np.array([xxhash.xxh64_intdigest(t) % coordinates for t in items.vocabulary], np.int64)
        self.flat = self.cell[np.concatenate(items.terms)]
        self.starts = np.cumsum([0, *(len(t) for t in items.terms[:-1])])
        self.lists = [t.tolist() for t in items.terms]

    def impacts(self, text: bytes) -> tuple[list[int], list[int], int]:
        """Numbers and frequencies of the block's terms in a text, and its number of terms."""
        found = terms_of(text)
        tf = Counter(found)
        vocabulary = self.items.vocabulary
        known = [(vocabulary[t], tf[t]) for t in vocabulary.keys() & tf.keys()]
        return [k for k, _ in known], [n for _, n in known], len(found)

    def fold(self, texts: list[bytes]) -> tuple[np.ndarray, list[dict[int, int]]]:
        """Each text's sketch, and its impacts by term."""
        parts = [self.impacts(t) for t in texts]
        sizes = [len(p[0]) for p in parts]
        row = np.repeat(np.arange(len(texts)), sizes)
        term = np.array([k for p in parts for k in p[0]], np.int64)
        tf = np.array([n for p in parts for n in p[1]], np.int64)
        m = np.repeat(np.array([length_norm(p[2], self.stats.documents, max(1, self.stats.total)) for p in parts], np.int64), sizes)
        value = self.weights[term] * saturated(tf, m)
        sketch = np.zeros((len(texts), self.coordinates), np.int64)
        np.maximum.at(sketch, (row, self.cell[term]), value)
        ends = np.cumsum(sizes)
        lists, terms = value.tolist(), term.tolist()
        exact = [dict(zip(terms[e - n : e], lists[e - n : e], strict=True)) for e, n in zip(ends.tolist(), sizes, strict=True)]
        return sketch, exact

    def bounds(self, sketch: np.ndarray) -> np.ndarray:
        """Documents by items."""
        return np.add.reduceat(sketch[:, self.flat], self.starts, axis=1)


class Best:
    """The best rows of each item so far: by score, then by id, null first."""

    def __init__(self, sketches: Sketches, best: int):
        self.sketches, self.best = sketches, best
        self.heaps: list[list[tuple[int, float]]] = [[] for _ in sketches.items.names]
        self.needed = np.ones(len(self.heaps), np.int64)
        self.rescored = 0

    def add(self, ids: list[int | None], texts: list[bytes]) -> None:
        sketch, exact = self.sketches.fold(texts)
        bounds = self.sketches.bounds(sketch)
        order = [math.inf if i is None else -i for i in ids]
        for item in np.flatnonzero((bounds >= self.needed).any(axis=0)).tolist():
            own, heap, terms = bounds[:, item], self.heaps[item], self.sketches.lists[item]
            rows = np.flatnonzero(own >= self.needed[item])
            for row in rows[np.argsort(-own[rows], kind="stable")].tolist():
                if own[row] < self.needed[item]:
                    break
                self.rescored += 1
                impact = exact[row]
                found = (sum(impact.get(t, 0) for t in terms), order[row])
                if found[0] <= 0:
                    continue
                if len(heap) < self.best:
                    heapq.heappush(heap, found)
                else:
                    heapq.heappushpop(heap, found)
                if len(heap) == self.best:
                    self.needed[item] = heap[0][0]  # an equal score may still win by its id


def _search(docs: DataFrame, items: Items, best: int, coordinates: int, id_column: str, text_column: str) -> DataFrame:
    """(item, doc_id, score): the best of each part of the documents for each item, by its number in the block."""
    stats = count(docs, items, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(items, stats, coordinates)
        found = Best(sketches, best)
        many = max(16, CELLS // max(len(sketches.flat), coordinates))
        for batch in batches:
            for part in slices(batch, "t"):
                for s in range(0, part.num_rows, many):
                    rows = part.slice(s, many)
                    found.add(rows.column("i").to_pylist(), bytes_of(rows.column("t")))
        rows = [(k, None if i == math.inf else -i, s) for k, heap in enumerate(found.heaps) for s, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"))
    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    coordinates: int = COORDINATES,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the `best` documents with a score above 0, highest first.

    Equal scores are ordered by id, null first. Items' text is in `text`; a
    null or empty one, or one without terms, has no rows; an item that
    stands in several rows has its rows for each. Each row of docs is a document,
    repeats included; null text has no terms. Items of equal text are searched
    once. The driver holds one block of BLOCK_BYTES of items at a time.
    """
    asked = items.select(F.col(item_column).cast("long").alias("item_id"), F.col("text").cast("string").alias("q")).where("q <> ''")
    asked = asked.withColumn("key", F.md5(F.col("q").cast("binary")))
    texts = stage(asked.groupBy("key").agg(F.first("q").alias("q")))
    size = texts.agg(F.sum(F.octet_length("q"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    found = None
    for k in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).orderBy("key").collect()
        block = Items.of([(r["key"], r["q"]) for r in own])
        if not block.names:
            continue
        some = _best(_search(docs, block, best, coordinates, id_column, text_column), best)
        names = docs.sparkSession.createDataFrame(list(enumerate(block.names)), "item long, key string")
        some = some.join(names, "item").select("key", "rank", "doc_id", "score")
        some = stage(some) if blocks > 1 else some
        found = some if found is None else found.union(some)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return asked.select("item_id", "key").join(found, "key").select("item_id", "rank", "doc_id", "score")


def _best(rows: DataFrame, best: int) -> DataFrame:
    """The best by item of the tasks' best, in two steps, so that no item brings together a row from every task."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    parted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    for keys in (["item", "part"], ["item"]):
        parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    return parted.drop("part")


SQL = f"""
  WITH terms AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
  sized AS MATERIALIZED (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM terms WHERE len(t) > 0),
  totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sized),
  asked AS MATERIALIZED (
    SELECT item_id, q, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term
    FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
  held AS MATERIALIZED (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
  weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM held CROSS JOIN totals GROUP BY term),
  impacts AS (
    SELECT h.r, h.term, w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (10 + (90 * s.n * docs) // total))) AS impact
    FROM held h JOIN sized s USING (r) JOIN weights USING (term) CROSS JOIN totals),
  scores AS (SELECT q, item_id, r, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY q, item_id, r),
  ranked AS (
    SELECT item_id, s.doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, s.doc_id NULLS FIRST) AS rank
    FROM scores JOIN sized s USING (r) WHERE score > 0)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {BEST}"""
